from decimal import Decimal

import logs
import model
import pytest
from pyspark.sql import functions as F

from bandstream.operators import fold
from bandstream.sources.tables import to_config_events

COLUMNS = ["op", "symbol_pair", "seq", "config_id", "price", "delta_percent", "config_event_at"]


def emitted(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("sizes", [{}, {"limit": 5}], ids=["whole", "cut"])
@pytest.mark.parametrize("seed", [4, 5, 6])
def test_changelog_matches_model(spark, seed, sizes):
    rows = logs.random_log(seed, 900)
    got = emitted(fold.fold_changelog(logs.frame(spark, rows), **sizes))
    assert got == sorted(model.fold(rows)[0])


@pytest.mark.parametrize("seed", [7, 8])
def test_state_matches_model(spark, seed):
    rows = logs.random_log(seed, 700)
    got = {
        r["symbol_pair"]: (r["config_id"], r["price"], r["delta_percent"], r["config_event_at"])
        for r in fold.fold_state(logs.frame(spark, rows)).collect()
    }
    want = {
        k: (e["id"], e["price"], e["delta"], e["at"]) for k, e in model.fold(rows)[1].items()
    }
    assert got == want


def test_restart_from_cache_continues(spark):
    rows = logs.random_log(9, 800)
    cache = fold.fold_snapshot(fold.fold_state(logs.frame(spark, rows[:400])))
    seed = {
        r["symbol_pair"]: {
            "id": r["config_id"],
            "price": r["price"],
            "delta": r["delta_percent"],
            "at": r["config_event_at"],
        }
        for r in cache.collect()
    }
    later = logs.frame(spark, rows[400:])
    configs = spark.createDataFrame(
        [], "id long, symbol_pair string, delta_percent decimal(9,6), config_event_at long"
    )
    restored = fold.restore_seed(cache, configs)
    got = emitted(fold.fold_changelog(later, seed=restored, limit=5))
    assert got == sorted(model.fold(rows[400:], seed)[0])


def test_empty_cache_falls_back_to_the_config_table(spark):
    shape = "symbol_pair string, config_id long, price decimal(24,8), delta_percent decimal(9,6), config_event_at long"
    phantom = spark.createDataFrame([("A:phantom", 1, None, None, 1)], shape)
    table = to_config_events(
        spark.sql("select 1L id, 'A' symbol_pair, 2.5BD delta_percent, timestamp_millis(50) updated_at")
    )
    rows = [logs.tick(1, "4")]
    seed = fold.restore_seed(phantom, table)
    got = emitted(fold.fold_changelog(logs.frame(spark, rows), seed=seed))
    assert got == [("U", "A", 1, 1, Decimal("4"), Decimal("2.5"), 50)]


def ops(spark, rows):
    out = fold.fold_changelog(logs.frame(spark, rows)).orderBy("seq").collect()
    return [(r["op"], r["seq"]) for r in out]


def test_delete_ignores_time_and_late_revision_starts_anew(spark):
    rows = [
        logs.tick(1, "5"),
        logs.config(2, 100, "1"),
        logs.config(3, 1, None, deleted=True),
        logs.config(4, 50, "2"),
        logs.tick(5, "5"),
    ]
    assert ops(spark, rows) == [("U", 2), ("D", 3), ("U", 5)]


def test_tick_first_rejects_time_zero(spark):
    assert ops(spark, [logs.tick(1, "5"), logs.config(2, 0, "1")]) == []
    assert ops(spark, [logs.config(1, 0, "1"), logs.tick(2, "5")]) == [("U", 2)]


def test_tie_is_rejected_and_equal_values_are_silent(spark):
    rows = [
        logs.tick(1, "5"),
        logs.config(2, 100, "1.0"),
        logs.config(3, 100, "2"),
        logs.config(4, 101, "1.000000"),
        logs.tick(5, "5.0"),
        logs.config(6, 101, "3"),
    ]
    assert ops(spark, rows) == [("U", 2)]


def test_null_price_emits_nothing(spark):
    rows = [logs.tick(1, "5"), logs.config(2, 100, "1"), logs.tick(3, None), logs.tick(4, "6")]
    assert ops(spark, rows) == [("U", 2), ("U", 4)]


def projected(spark, ops_, size):
    rows = [("A", i, op, Decimal(i)) for i, op in enumerate(ops_)]
    df = spark.createDataFrame(rows, "symbol_pair string, seq long, op string, price decimal(24,8)")
    return [r["seq"] for r in fold.project_fold_batches(df, size).collect()]


def test_delete_wins_inside_a_sink_batch(spark):
    assert projected(spark, "DU", 100) == []
    assert projected(spark, "DU", 1) == [1]
    assert projected(spark, "UDUU", 2) == [3]
    assert projected(spark, "UUUD", 2) == []


def test_reconcile_changes_nothing_already_known(spark):
    rows = [logs.tick(1, "5"), logs.config(2, 100, "1")]
    table = spark.sql(
        "select 1L id, 'A' symbol_pair, cast(1 as decimal(9,6)) delta_percent, 100L config_event_at"
    )
    log = fold.reconcile_log(logs.frame(spark, rows), table, F.lit(10).cast("long"))
    assert [r[2] for r in emitted(fold.fold_changelog(log))] == [2]
    newer = table.withColumns({"config_event_at": F.lit(200).cast("long"), "delta_percent": F.lit(2).cast("decimal(9,6)")})
    log = fold.reconcile_log(logs.frame(spark, rows), newer, F.lit(10).cast("long"))
    assert [r[2] for r in emitted(fold.fold_changelog(log))] == [2, 10]
