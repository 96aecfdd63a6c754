import random

import pytest
from pyspark.sql import types as T

CLASHING = ["fp", "hash", "k1", "k2", "h", "size", "vote", "lines", "held", "ids", "_raw", "raw",
            "key", "copies", "removed", "n_tokens", "TEXT2", "kept", "scores", "host"]


def doc_schema(extra=()):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
              ("source", T.StringType()), ("n_chars", T.LongType())]
    fields += [(c, T.StringType()) for c in extra]
    return T.StructType([T.StructField(n, k) for n, k in fields])


def words(seed, n):
    draw = random.Random(seed)
    parts = "tha er ing ou le mont ri sta be co da fe gu hi jo ka lu me no po".split()
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(n)]


def text_of(seed, n):
    draw, out = random.Random(seed * 7 + 1), []
    for i, w in enumerate(words(seed, n)):
        out.append(w + ("\n" if draw.random() < 0.1 else ""))
    return " ".join(out).replace("\n ", "\n")


ODD = [
    (None, None, None, None, None),
    (None, text_of(3, 80), "en", None, None),
    (900, "", "en", "a", 0),
    (901, None, "fr", "a", None),
    (902, "   \n\n ", None, "b", 5),
    (903, "one", "en", "b", 3),
    (903, "one", "en", "b", 3),
    (904, "x" * 30_000, "en", "b", 30_000),
    (905, "\U0001f600 éß中文   \x00 \x1c tail", "de", "c", 20),
    (906, " ".join(["same"] * 4000), "en", "c", 20_000),
    (907, "a\n" * 3000, "en", "c", 6000),
    (908, text_of(5, 20_000), "en", "c", 100_000),
]


class Folder:
    """Writes tables where the queries look for them."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def put(self, name, df):
        df.write.mode("overwrite").parquet(f"{self.path}/{name}.parquet")
        return self

    def docs(self, rows, extra=()):
        padded = [(*r, *["x"] * len(extra)) for r in rows]
        return self.put("documents", self.spark.createDataFrame(padded, doc_schema(extra)))


@pytest.fixture()
def folder(spark, tmp_path):
    made = Folder(spark, tmp_path)
    made.put("benchmark", spark.createDataFrame([], "item_id long, text string"))
    made.put("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    return made


@pytest.fixture()
def odd(folder):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    return folder.docs(ODD, CLASHING)


@pytest.fixture()
def empty(folder):
    folder.put("pages", folder.spark.createDataFrame([], "page_id long, url string, html string"))
    folder.put(
        "embeddings",
        folder.spark.createDataFrame([], "vec_id long, embedding array<float>, label int"),
    )
    return folder.docs([])
