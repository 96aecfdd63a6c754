import logs
import model
import pytest

from pyspark.sql import types as T

from bandstream.operators import fold, joins, projection
from bandstream.operators.latest import live_rows
from bandstream.schemas import CHANGELOG, FOLD_CHANGELOG, TAGGED_LOG
from bandstream.session import scratch_path
from bandstream.sources import records
from bandstream.sources.store import CompactedChangelog
from bandstream.streaming import changelogs, keyed, sinks


def replay(spark, rows, pieces, build, schema, sink=sinks.append_into):
    """Feed a log piece by piece; the query stops and resumes in between."""
    source, progress = scratch_path(spark, "in"), scratch_path(spark, "ck")
    store = CompactedChangelog(spark, scratch_path(spark, "out"), schema)
    step = -(-len(rows) // pieces)
    for start in range(0, len(rows), step):
        logs.frame(spark, rows[start : start + step]).write.mode("append").parquet(source)
        stream = build(records.file_stream(spark, source, TAGGED_LOG))
        sinks.start(stream, sink(store), progress, available_now=True).awaitTermination()
    return store


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_upkeep_keeps_the_store_small(spark):
    rows = logs.random_log(18, 200, tombstones=True)
    sink = lambda store: sinks.project_into(store, upkeep=2)
    store = replay(spark, rows, 5, joins.join_state, CHANGELOG, sink)
    want = live_rows(joins.join_changelog(logs.frame(spark, rows))).drop("seq")
    assert same(store.read().drop("seq"), want)
    assert store.commits() == [4]


@pytest.mark.parametrize("pieces", [1, 4])
def test_update_mode_join_ends_like_the_batch(spark, pieces):
    rows = logs.random_log(11, 300, tombstones=True)
    store = replay(spark, rows, pieces, joins.join_state, CHANGELOG, sinks.project_into)
    want = live_rows(joins.join_changelog(logs.frame(spark, rows))).drop("seq")
    assert same(store.read().drop("seq"), want)


def replay_events(spark, batches, into, schema, state_schema, seed=None):
    """Feed batches of rows through a per-event sink, one query run each."""
    source, progress = scratch_path(spark, "in"), scratch_path(spark, "ck")
    changes = CompactedChangelog(spark, scratch_path(spark, "out"), schema)
    state = keyed.KeyedState(spark, scratch_path(spark, "state"), state_schema, buckets=3)
    if seed is not None:
        state.start_from(seed)
    for rows in batches:
        logs.frame(spark, rows).write.mode("append").parquet(source)
        stream = records.file_stream(spark, source, TAGGED_LOG)
        sink = into(changes, state)
        sinks.start(stream, sink, progress, "append", available_now=True).awaitTermination()
    return changes, state


def chunks(rows, n):
    step = -(-len(rows) // n)
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def test_per_event_join_changelog(spark):
    rows = logs.random_log(12, 300, tombstones=True)
    changes, _ = replay_events(
        spark, chunks(rows, 5), changelogs.join_into, CHANGELOG, changelogs.JOIN_STATE
    )
    assert len(changes.commits()) == 5
    assert same(changes.changes().drop("batch_id"), joins.join_changelog(logs.frame(spark, rows)))


def test_per_event_fold_changelog(spark):
    rows = logs.random_log(13, 300)
    changes, _ = replay_events(
        spark, chunks(rows, 5), changelogs.fold_into, FOLD_CHANGELOG, changelogs.FOLD_STATE
    )
    assert same(changes.changes().drop("batch_id"), fold.fold_changelog(logs.frame(spark, rows)))


def test_late_rows_do_not_replace_newer_ones(spark):
    """Batches out of order: the kept state ends as that of the ordered log."""
    rows = logs.random_log(16, 240, tombstones=True)
    a, b, c, d = chunks(rows, 4)
    _, state = replay_events(
        spark, [a, c, b, d], changelogs.join_into, CHANGELOG, changelogs.JOIN_STATE
    )
    want = joins.join_changelog(logs.frame(spark, rows))
    held = state.read().where("NOT config.deleted AND NOT coalesce(price.deleted, false)")
    got = held.select("symbol_pair", "config.id", "config.delta_percent", "price.price")
    table = live_rows(want).select("symbol_pair", "config_id", "delta_percent", "price")
    assert same(got.toDF(*table.columns), table)


STEPS = [
    (changelogs.fold_into, FOLD_CHANGELOG, changelogs.FOLD_STATE),
    (changelogs.join_into, CHANGELOG, changelogs.JOIN_STATE),
]


@pytest.mark.parametrize("into,schema,state_schema", STEPS)
def test_a_repeated_batch_changes_nothing(spark, into, schema, state_schema):
    """Also after upkeep of the changelog, and when the state was written only in part."""
    pieces = chunks(logs.random_log(17, 240), 4)
    changes = CompactedChangelog(spark, scratch_path(spark, "out"), schema)
    state = keyed.KeyedState(spark, scratch_path(spark, "state"), state_schema, buckets=2)
    write = into(changes, state)
    text = lambda df: sorted(map(str, df.collect()))
    for batch_id, rows in enumerate(pieces):
        write(logs.frame(spark, rows), batch_id)
        before = text(changes.read()), text(state.read())
        if batch_id == 2:
            changes.compact()
            changes.vacuum()
        if batch_id == 3:  # a crash after the first bucket
            opened = state.open(logs.frame(spark, rows), batch_id)
            opened.buckets = opened.buckets[:1]
            opened.replace(opened.rows().limit(0))
        write(logs.frame(spark, rows), batch_id)
        assert (text(changes.read()), text(state.read())) == before


def test_a_batch_of_one_symbol_reads_one_bucket(spark):
    changes = CompactedChangelog(spark, scratch_path(spark, "out"), FOLD_CHANGELOG)
    state = keyed.KeyedState(spark, scratch_path(spark, "state"), changelogs.FOLD_STATE, buckets=8)
    write = changelogs.fold_into(changes, state)
    rows = logs.random_log(19, 400)
    write(logs.frame(spark, rows), 0)
    assert len(state._versions(None, None)) > 1
    one = logs.frame(spark, [r for r in rows if r["symbol_pair"] == rows[0]["symbol_pair"]])
    opened = state.open(one, 1)
    assert len(opened.versions) == 1
    plan = opened.rows()._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1]
    assert "bucket" in filters.split("]")[0] and "slot" in filters.split("]")[0]
    stamps = lambda: {b: v for b, v in state._versions(None, None).items()}
    before = stamps()
    write(one, 1)
    changed = [b for b, v in stamps().items() if before.get(b) != v]
    assert len(changed) == 1 and stamps()[changed[0]][0] == 1


def test_state_without_keys_left(spark):
    shape = T.StructType([T.StructField("symbol_pair", T.StringType())])
    state = keyed.KeyedState(spark, scratch_path(spark, "state"), shape, buckets=1)
    keys = spark.createDataFrame([("A",), ("B",)], shape)
    assert state.read().count() == 0
    state.open(keys, 0).replace(keys)
    state.open(keys, 1).replace(keys.limit(0))
    assert state.read().count() == 0
    assert state.open(keys, 1).rows().count() == 2


def test_streaming_fold_starts_from_restored_entries(spark):
    rows = logs.random_log(14, 300)
    cache = fold.fold_snapshot(fold.fold_state(logs.frame(spark, rows[:150])))
    seed = cache.select("symbol_pair", "config_id", "price", "delta_percent", "config_event_at")
    seed = spark.createDataFrame(seed.collect(), seed.schema)
    later = rows[150:]
    changes, _ = replay_events(
        spark, chunks(later, 2), changelogs.fold_into, FOLD_CHANGELOG, changelogs.FOLD_STATE, seed
    )
    want = fold.fold_changelog(logs.frame(spark, later), seed=seed)
    assert same(changes.changes().drop("batch_id"), want)
    entries = {
        r["symbol_pair"]: dict(
            id=r["config_id"], price=r["price"], delta=r["delta_percent"], at=r["config_event_at"]
        )
        for r in seed.collect()
    }
    assert changes.changes().count() == len(model.fold(later, entries)[0])


def test_metrics_and_expiry_of_a_projected_stream(spark):
    rows = logs.random_log(15, 120)
    shape = T.StructType(CHANGELOG.fields + [T.StructField("expires_at", T.LongType())])
    store = CompactedChangelog(spark, scratch_path(spark, "out"), shape)
    source = scratch_path(spark, "in")
    logs.frame(spark, rows).write.parquet(source)
    stream = sinks.observed(joins.join_state(records.file_stream(spark, source, TAGGED_LOG)))
    sink = sinks.project_into(store, ttl_ms=1000, clock=lambda: 5)
    running = sinks.start(stream, sink, scratch_path(spark, "ck"), available_now=True)
    running.awaitTermination()
    seen = running.recentProgress[0].observedMetrics["changes"]
    symbols = {r["symbol_pair"] for r in rows if r["symbol_pair"]}
    assert seen["records"] == len(symbols) == seen["upserts"] + seen["deletions"]
    assert {r["expires_at"] for r in store.read().collect()} == {6000}
    assert projection.alive(store.read(), 6000).isEmpty()
