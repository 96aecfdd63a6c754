"""State per key in plain Parquet, of which a batch reads and writes only its buckets.

Layout: ``bucket=B/slot=S``.  A key belongs to the bucket of its hash, and each
bucket has two slots.  Batch N reads, per bucket it touches, the slot whose rows
have the highest batch below N, and writes the bucket's new contents into the other
slot (dynamic partition overwrite).  So

* the cost of a batch follows the buckets it touches, not the number of keys;
* what was before batch N is still there while and after N is written, so a batch
  that is delivered again, even after a crash in the middle of its write, gives
  the same contents;
* a bucket never has more than two versions, and there is nothing to clean up.

Every version has one row without a key, which says which batch wrote it even
where no key is left.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


class KeyedState:
    """``schema`` is that of the rows kept, one per key, with the column ``key``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str = "symbol_pair",
        buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.buckets = key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        shape = T.StructType(
            [
                *self.schema.fields,
                T.StructField("batch", T.LongType()),
                T.StructField("bucket", T.IntegerType()),
                T.StructField("slot", T.IntegerType()),
            ]
        )
        try:
            return self.spark.read.schema(shape).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _versions(self, before: int | None, buckets: list[int] | None) -> dict[int, tuple]:
        """Newest (batch, slot) per bucket; at most two rows per bucket reach the driver."""
        rows = self._stored()
        if rows is None:
            return {}
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        found = rows.where(F.col(self.key).isNull()).groupBy("bucket", "slot").agg(F.max("batch"))
        newest: dict[int, tuple] = {}
        for bucket, slot, batch in found.collect():
            if before is None or batch < before:
                newest[bucket] = max(newest.get(bucket, (batch, slot)), (batch, slot))
        return newest

    def _contents(self, versions: dict[int, tuple]) -> DataFrame:
        rows = self._stored() if versions else None
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        # literals on the partition columns: only these folders are listed and read
        wanted = [
            (F.col("slot") == slot)
            & F.col("bucket").isin([b for b, (_, s) in versions.items() if s == slot])
            for slot in sorted({s for _, s in versions.values()})
        ]
        return rows.where(reduce(or_, wanted) & F.col(self.key).isNotNull()).select(
            *self.schema.names
        )

    def read(self) -> DataFrame:
        """The newest contents of all buckets."""
        return self._contents(self._versions(None, None))

    def open(self, batch: DataFrame, batch_id: int) -> "Opened":
        """The buckets that the keys of ``batch`` are in, as they were before it."""
        touched = batch.select(self.bucket().alias("b")).distinct().collect()
        buckets = sorted(row["b"] for row in touched)  # at most ``buckets`` of them
        return Opened(self, batch_id, buckets, self._versions(batch_id, buckets))

    def start_from(self, table: DataFrame) -> None:
        """Make ``table`` the contents before the first batch."""
        Opened(self, -1, list(range(self.buckets)), {}).replace(table)


class Opened:
    def __init__(self, state: KeyedState, batch_id: int, buckets: list[int], versions: dict):
        self.state, self.batch_id = state, batch_id
        self.buckets, self.versions = buckets, versions

    def rows(self) -> DataFrame:
        return self.state._contents(self.versions)

    def replace(self, contents: DataFrame) -> None:
        """Write ``contents`` as what the buckets hold after the batch."""
        state = self.state
        marks = state.spark.createDataFrame(
            [(b, 1 - self.versions[b][1] if b in self.versions else 0) for b in self.buckets],
            "bucket int, slot int",
        )
        rows = contents.select(*state.schema.names, state.bucket().alias("bucket")).join(
            F.broadcast(marks), "bucket"  # one row per bucket
        )
        rows = rows.unionByName(marks, allowMissingColumns=True)
        (
            rows.withColumn("batch", F.lit(self.batch_id).cast("long"))
            .repartition(len(self.buckets) or 1, "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "slot")
            .parquet(state.path)
        )
