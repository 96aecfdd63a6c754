"""A compacted changelog on plain Parquet.

Layout below one folder:

    log/batch_id=N/    records of batch N; writing N again replaces them
    commits/N          empty file, written after the records
    base/version=V/    one row per live key, up to some batch
    versions/V-N       empty file that names that batch, written after the base

Readers see batches that have a commit mark and the newest base that has a
version mark, so a half-written one is invisible, and a batch that is delivered
twice leaves the same table.  ``vacuum`` keeps the marks few: a reader lists
those since the last base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.operators.latest import latest_by


class StoreUnavailable(RuntimeError):
    """Nothing has been committed to the store yet."""


class CompactedChangelog:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str = "symbol_pair",
    ):
        """``schema`` is that of the changelog, with ``op`` and ``seq``."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = key

    def append(self, changes: DataFrame, batch_id: int) -> None:
        rows = changes.select(*self.schema.names)
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        self._mark(f"commits/{batch_id}")

    def append_batches(self, changes: DataFrame, batch_col: str, batch_ids: list[int]) -> None:
        """Append a changelog that spans the batches ``batch_ids``, in one pass."""
        rows = changes.select(*self.schema.names, F.col(batch_col).alias("batch_id"))
        (
            rows.where(F.col("batch_id").isin(batch_ids))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(f"{self.path}/log")
        )
        for batch_id in batch_ids:
            self._mark(f"commits/{batch_id}")

    def _files(self, name: str):
        """The file system, and the path of ``name`` in it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _mark(self, name: str) -> None:
        files, path = self._files(name)
        files.create(path, True).close()

    def _exists(self, name: str) -> bool:
        files, path = self._files(name)
        return files.exists(path)

    def _marks(self, name: str) -> list[str]:
        if not self._exists(name):
            return []
        files, path = self._files(name)
        return [f.getPath().getName() for f in files.listStatus(path)]

    def commits(self) -> list[int]:
        """Committed batches that ``vacuum`` has not removed."""
        return sorted(int(n) for n in self._marks("commits"))

    def _versions(self) -> list[tuple[int, int]]:
        """(last batch, version) of the bases."""
        marks = (n.split("-", 1) for n in self._marks("versions"))
        return sorted((int(upto), int(version)) for version, upto in marks)

    def _base(self, as_of: int | None) -> tuple[int | None, int]:
        """Newest base version not past ``as_of``, and the batch it covers."""
        found = [v for v in self._versions() if as_of is None or v[0] <= as_of]
        return (found[-1][1], found[-1][0]) if found else (None, -1)

    def start_from(self, table: DataFrame) -> None:
        """Make ``table`` (without ``op``) the contents before the first batch."""
        self._write_base(table.select(*[n for n in self.schema.names if n != "op"]), 0, -1)

    def _write_base(self, table: DataFrame, version: int, upto: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/base/version={version}")
        self._mark(f"versions/{version}-{upto}")

    def changes(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Committed records of the batches in ``(after, upto]``, with ``batch_id``."""
        shape = T.StructType(self.schema.fields + [T.StructField("batch_id", T.LongType())])
        if not self._exists("log"):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/log")
        wanted = [n for n in self.commits() if n > after and (upto is None or n <= upto)]
        return rows.where(F.col("batch_id").isin(wanted))

    def read(self, as_of: int | None = None) -> DataFrame:
        """The table as of a batch (default: now): one row per live key.

        The base has one row per key already.  Only the records since then are
        aggregated, and the base loses the keys they touch.
        """
        version, upto = self._base(as_of)
        if version is None and not self.commits():
            raise StoreUnavailable(self.path)
        tail = latest_by(self.changes(upto, as_of), [self.key], ["batch_id", "seq"])
        live = tail.where(F.col("op") != "D").drop("batch_id", "op")
        if version is None:
            return live
        shape = T.StructType([f for f in self.schema if f.name != "op"])
        base = self.spark.read.schema(shape).parquet(f"{self.path}/base/version={version}")
        kept = base.join(tail.select(self.key), self.key, "left_anti")
        return kept.unionByName(live)

    def compact(self, upto: int | None = None) -> int:
        """Write a new base of the committed batches (up to ``upto``); returns its version."""
        commits = [n for n in self.commits() if upto is None or n <= upto]
        version, covered = self._base(None)
        if not commits or commits[-1] <= covered:
            return -1 if version is None else version
        new = 1 if version is None else version + 1
        self._write_base(self.read(commits[-1]), new, commits[-1])
        return new

    def vacuum(self) -> None:
        """Delete the batches and bases the newest base has replaced.

        Reads of older points in time end here.
        """
        version, upto = self._base(None)
        if version is None:
            return
        for batch_id in self.commits():
            if batch_id <= upto:
                self._delete(f"commits/{batch_id}")
                self._delete(f"log/batch_id={batch_id}")
        for covered, other in self._versions():
            if other != version:
                self._delete(f"versions/{other}-{covered}")
                self._delete(f"base/version={other}")

    def _delete(self, name: str) -> None:
        files, path = self._files(name)
        files.delete(path, True)
