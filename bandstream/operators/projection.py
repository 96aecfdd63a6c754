"""Projections with a time to live, and paged reads of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.operators.latest import collapse
from bandstream.operators.runs import number_rows

# 30 minutes to live, renewed every 5; 20 rows per page.
TTL_MS = 1_800_000
RENEW_MS = 300_000
PAGE_SIZE = 20
#: Rows per folder of a stored page index.
BLOCK_ROWS = 100_000
PHANTOM_SUFFIX = ":phantom"


def expires_at(
    written: Column,
    ttl_ms: int = TTL_MS,
    renew_ms: int | None = None,
    renew_from: int = 0,
    renew_until: int | None = None,
) -> Column:
    """When a key written at ``written`` expires.

    With a renewer, which first runs at ``renew_from + renew_ms`` and last at or
    before ``renew_until``, every run that finds the key alive gives it a full
    time to live again.
    """
    plain = written + ttl_ms
    if renew_ms is None:
        return plain
    passed = F.greatest(F.floor((written - renew_from) / renew_ms), F.lit(0))
    first = (passed + 1).cast("long") * renew_ms + renew_from
    in_time = first < plain
    if renew_until is None:
        if renew_ms < ttl_ms:
            return F.when(in_time, F.lit(None)).otherwise(plain).cast("long")
        return F.when(in_time, first + ttl_ms).otherwise(plain)
    last = (renew_until - renew_from) // renew_ms * renew_ms + renew_from
    renewed = F.lit(last + ttl_ms) if renew_ms < ttl_ms else first + ttl_ms
    return F.when(in_time & (first <= renew_until), renewed).otherwise(plain)


def with_ttl(projection: DataFrame, written: Column, **ttl) -> DataFrame:
    return projection.withColumn("expires_at", expires_at(written, **ttl))


def alive(projection: DataFrame, as_of: Column | int) -> DataFrame:
    """Rows to serve: not expired, with a key, and no shadow copies."""
    key = F.col("symbol_pair")
    forever = F.col("expires_at").isNull()
    return projection.where(
        (forever | (F.col("expires_at") > as_of))
        & key.isNotNull()
        & ~key.endswith(PHANTOM_SUFFIX)
    )


def project(changelog: DataFrame, written: Column, as_of: int, **ttl) -> DataFrame:
    """The table a changelog leaves behind at ``as_of``: collapsed, unexpired."""
    rows = collapse(changelog).where(F.col("op") == "U").drop("op")
    return alive(with_ttl(rows, written, **ttl), as_of)


def by_symbol(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("symbol_pair").asc_nulls_last())


def page(
    df: DataFrame,
    number: int = 0,
    size: int = PAGE_SIZE,
    sort: str = "symbol_pair",
    desc: bool = False,
) -> DataFrame:
    """Page ``number`` of ``size`` rows; empty past the end.

    Nulls come last and the symbol breaks ties, so pages do not overlap.
    """
    return df.orderBy(*page_order(sort, desc)).offset(number * size).limit(size)


def page_order(sort: str = "symbol_pair", desc: bool = False) -> list[Column]:
    column = F.col(sort)
    order = [column.desc_nulls_last() if desc else column.asc_nulls_last()]
    if sort != "symbol_pair":
        order.append(F.col("symbol_pair").asc_nulls_last())
    return order


class PageIndex:
    """A projection stored in sort order, so that every page costs the same.

    Rows carry their rank and lie in folders of ``block_rows`` ranks each; a page
    reads the folders its ranks are in, mostly one, and sorts ``size`` rows.
    The order is that of ``page``.  ``schema`` is that of the projection.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, block_rows: int = BLOCK_ROWS):
        self.spark, self.path, self.schema = spark, path, schema
        self.block_rows = block_rows

    def write(self, df: DataFrame, sort: str = "symbol_pair", desc: bool = False) -> None:
        """Replace the contents; range partitioned, no task sorts them all."""
        rows = number_rows(df.select(*self.schema.names), page_order(sort, desc), "rank")
        block = F.floor(F.col("rank") / self.block_rows).cast("long")
        (
            rows.withColumn("block", block)
            .sortWithinPartitions("block", "rank")
            .write.mode("overwrite")
            .partitionBy("block")
            .parquet(self.path)
        )

    def rows(self) -> DataFrame:
        """All rows with ``rank`` and ``block``."""
        ranks = [T.StructField("rank", T.LongType()), T.StructField("block", T.LongType())]
        shape = T.StructType([*self.schema.fields, *ranks])
        return self.spark.read.schema(shape).parquet(self.path)

    def page(self, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` of ``size`` rows; empty past the end."""
        first, last = number * size, (number + 1) * size - 1
        blocks = F.col("block").between(first // self.block_rows, last // self.block_rows)
        rows = self.rows().where(blocks & F.col("rank").between(first, last))
        return rows.orderBy("rank").select(*self.schema.names)


def page_after(
    df: DataFrame,
    after: tuple | None = None,
    size: int = PAGE_SIZE,
    sort: str = "symbol_pair",
    desc: bool = False,
) -> DataFrame:
    """The ``size`` rows that follow the row with sort value and symbol ``after``.

    Same order as ``page``, at the same cost for every page: rows before it are
    filtered out in the scan, and each task keeps ``size`` of the others.
    """
    rows = df
    if after is not None:
        value, symbol = after
        column, name = F.col(sort), F.col("symbol_pair")
        later = name.isNull() if symbol is not None else F.lit(False)
        if symbol is not None:
            later = later | (name > symbol)
        if value is None:
            beyond = column.isNull() & later
        else:
            further = column < F.lit(value) if desc else column > F.lit(value)
            beyond = column.isNull() | further | ((column == F.lit(value)) & later)
        rows = df.where(beyond)
    return page(rows, 0, size, sort, desc)


def page_meta(df: DataFrame, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One row: page, size, total_elements, total_pages, first, last."""
    total = F.count("*").alias("total_elements")
    pages = F.ceil(F.col("total_elements") / size).cast("int")
    return (
        df.agg(total)
        .withColumn("total_pages", pages)
        .select(
            F.lit(number).alias("page"),
            F.lit(size).alias("size"),
            "total_elements",
            "total_pages",
            F.lit(number == 0).alias("first"),
            (F.lit(number + 1) >= F.col("total_pages")).alias("last"),
        )
    )
