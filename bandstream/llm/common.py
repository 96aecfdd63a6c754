"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.session import configure, stored

__all__ = ["Generations", "discard", "doc_key", "fields", "fresh", "prepare", "stored", "table", "text_bytes"]

#: Rows and bytes handed to a Python worker at once; bounds its memory, not the result.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the package plus bounded Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the folder that ``stored`` wrote, once nothing reads ``df`` any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def text_bytes(column: str | Column = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def doc_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row in joins; nulls allowed.

    Rows with equal ``columns`` share the key: they are the same document.
    """
    cols = [F.col(c) for c in columns]
    return [
        F.xxhash64(F.lit(1), *cols),
        F.xxhash64(F.lit(2), *[c.isNull() for c in cols], *reversed(cols)),
    ]


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class Generations:
    """A bounded cache: what two generations in a row did not ask for is forgotten.

    Keys above ``chars`` characters are forgotten with the next call.
    """

    def __init__(self, size: int, chars: int = 40):
        self.size, self.chars = size, chars
        self.now: dict = {}
        self.before: dict = {}
        self.long: list[str] = []

    def get(self, keys: list[str], learn) -> dict:
        """A dict that has all ``keys``; ``learn`` gives those that are not known."""
        for key in self.long:
            self.now.pop(key, None)
        if len(self.now) > self.size:
            self.before, self.now = self.now, {}
        missing = set(keys).difference(self.now)
        back = missing.intersection(self.before)
        self.now.update({k: self.before[k] for k in back})
        new = learn(list(missing - back))
        self.now.update(new)
        self.long = [k for k in new if len(k) > self.chars]
        return self.now
