import pytest

from bandstream.schemas import _fields
from bandstream.session import scratch_path
from bandstream.sources.store import CompactedChangelog, StoreUnavailable
from pyspark.sql import types as T

SHAPE = _fields(
    ("symbol_pair", T.StringType()),
    ("v", T.LongType()),
    ("op", T.StringType()),
    ("seq", T.LongType()),
)


@pytest.fixture
def store(spark):
    return CompactedChangelog(spark, scratch_path(spark, "store"), SHAPE)


def batch(spark, *rows):
    return spark.createDataFrame(rows, SHAPE)


def table(store, as_of=None):
    return {r["symbol_pair"]: r["v"] for r in store.read(as_of).collect()}


def test_unwritten_store_is_unavailable(store):
    with pytest.raises(StoreUnavailable):
        store.read()


def test_batches_replay_compaction_and_history(spark, store):
    store.append(batch(spark, ("A", 1, "U", 5), ("B", 2, "U", 6)), 0)
    store.append(batch(spark, ("A", 3, "U", 1), ("B", None, "D", 2), ("C", 4, "U", 3)), 1)
    assert table(store) == {"A": 3, "C": 4}
    assert table(store, as_of=0) == {"A": 1, "B": 2}
    store.append(batch(spark, ("A", 3, "U", 1), ("B", None, "D", 2), ("C", 4, "U", 3)), 1)
    assert table(store) == {"A": 3, "C": 4}
    assert store.changes().count() == 5

    assert store.compact() == 1
    assert store.compact() == 1
    store.append(batch(spark, ("A", None, "D", 9), ("B", 7, "U", 9)), 2)
    assert table(store) == {"B": 7, "C": 4}
    assert table(store, as_of=0) == {"A": 1, "B": 2}
    assert store.compact() == 2
    store.vacuum()
    assert table(store) == {"B": 7, "C": 4}
    assert store.commits() == []


def test_uncommitted_batches_are_invisible(spark, store):
    store.append(batch(spark, ("A", 1, "U", 1)), 0)
    batch(spark, ("A", 9, "U", 9)).write.parquet(f"{store.path}/log/batch_id=1")
    batch(spark, ("Z", 9, "U", 9)).drop("op").write.parquet(f"{store.path}/base/version=8")
    assert table(store) == {"A": 1}


def test_many_batches_in_one_pass(spark, store):
    rows = batch(spark, ("A", 1, "U", 1), ("A", 2, "U", 2), ("B", 3, "U", 3))
    store.append_batches(rows.withColumn("batch", rows.seq % 2), "batch", [0, 1])
    assert table(store) == {"A": 1, "B": 3}
    assert table(store, as_of=0) == {"A": 2}
    assert store.compact(upto=0) == 1
    assert table(store) == {"A": 1, "B": 3}
