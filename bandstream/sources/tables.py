"""The price config table: scans, keyed lookups, conversion to config events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.functions.text import epoch_millis
from bandstream.schemas import PRICE_CONFIG


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_CONFIG).parquet(path)


def read_configs_jdbc(
    spark: SparkSession,
    url: str,
    lower: int,
    upper: int,
    partitions: int,
    table: str = "price_configs",
    **options: str,
) -> DataFrame:
    """Read the table over JDBC in ``partitions`` id ranges at a time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn="id",
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    ).load()


def config_list(configs: DataFrame) -> DataFrame:
    return configs.select(*PRICE_CONFIG.names)


def find_by(configs: DataFrame, column: str, value) -> DataFrame:
    """One key: a filter, which the scan pushes down."""
    return configs.where(F.col(column) == value)


def lookup(configs: DataFrame, keys: DataFrame, on: str = "symbol_pair") -> DataFrame:
    """Many keys: each key row with its config, and ``found``."""
    marked = configs.withColumn("found", F.lit(True))
    return keys.join(marked, on, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def to_config_events(configs: DataFrame, deleted: bool = False, seq: int = -1) -> DataFrame:
    """Table rows as config events stamped with their ``updated_at``."""
    return configs.select(
        "id",
        "symbol_pair",
        "delta_percent",
        epoch_millis(F.col("updated_at")).alias("config_event_at"),
        F.lit(deleted).alias("deleted"),
        F.lit(seq).cast("long").alias("seq"),
    )


def commit_together(path: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Write several tables as one unit: nobody reads any before all are there.

    Each goes below its own folder under ``batch_id``; the commit row comes
    last, and doing a batch again replaces it.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    spark = next(iter(tables.values())).sparkSession
    mark = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).coalesce(1)
    mark.write.mode("overwrite").parquet(f"{path}/_done/{batch_id}")


def read_committed(
    spark: SparkSession, path: str, name: str, schema: T.StructType, whole: bool = False
) -> DataFrame:
    """The newest committed version of a table, or (``whole``) all its batches."""
    done = spark.read.schema("batch_id long").parquet(f"{path}/_done/*")
    shape = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(shape).parquet(f"{path}/{name}")
    if whole:
        rows = rows.join(done, "batch_id", "left_semi")
    else:
        rows = rows.where(F.col("batch_id") == done.agg(F.max("batch_id")).first()[0])
    return rows.drop("batch_id")
