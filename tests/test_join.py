import logs
import model
import pytest
from pyspark.sql import functions as F

from bandstream.operators.joins import full_config, join_changelog, join_state, join_tables
from bandstream.operators.latest import latest_by, live_rows, merge_streams

COLUMNS = ["op", "symbol_pair", "seq", "config_id", "price", "delta_percent"]
WHOLE = {}
CUT = {"limit": 5}


def emitted(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("sizes", [WHOLE, CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("seed", [1, 2])
def test_changelog_matches_model(spark, seed, sizes):
    rows = logs.random_log(seed, 900, tombstones=True)
    got = emitted(join_changelog(logs.frame(spark, rows), **sizes))
    assert got == sorted(model.join_changelog(rows))


def test_state_is_the_end_of_the_changelog(spark):
    log = logs.frame(spark, logs.random_log(3, 600, tombstones=True))
    ends = live_rows(join_changelog(log)).drop("seq")
    state = join_state(log).where("op = 'U'").select(*ends.columns)
    assert ends.exceptAll(state).isEmpty() and state.exceptAll(ends).isEmpty()
    configs = log.where("side = 'C'").select(
        "id", "symbol_pair", "delta_percent", "config_event_at", "deleted", "seq"
    )
    prices = log.where("side = 'P'").select("symbol_pair", "price", "price_at", "deleted", "seq")
    joined = full_config(configs, prices).select(*ends.columns)
    assert ends.exceptAll(joined).isEmpty() and joined.exceptAll(ends).isEmpty()


def ops(spark, rows):
    return [(r["op"], r["seq"]) for r in join_changelog(logs.frame(spark, rows)).orderBy("seq").collect()]


def test_delete_with_the_same_time_wins_the_tie(spark):
    rows = [logs.tick(1, "5"), logs.config(2, 100, "1"), logs.config(3, 100, "1", deleted=True)]
    assert ops(spark, rows) == [("U", 2), ("D", 3)]


def test_late_revision_after_delete_stays_deleted(spark):
    rows = [
        logs.tick(1, "5"),
        logs.config(2, 100, "1"),
        logs.config(3, 200, "1", deleted=True),
        logs.config(4, 150, "2"),
    ]
    assert ops(spark, rows) == [("U", 2), ("D", 3)]


def test_null_price_keeps_a_row_without_band(spark):
    rows = [logs.tick(1, "5"), logs.config(2, 100, "1"), logs.tick(3, None)]
    last = join_changelog(logs.frame(spark, rows)).orderBy(F.desc("seq")).first()
    assert last["op"] == "U" and last["low_price"] is None and last["price"] is None


def test_rename_leaves_the_old_symbol(spark):
    rows = [
        logs.tick(1, "5", "A"),
        logs.tick(2, "6", "B"),
        logs.config(3, 100, "1", "A"),
        logs.config(4, 200, "1", "B"),
    ]
    assert ops(spark, rows) == [("U", 3), ("U", 4)]


def test_generic_join_of_one_table_with_itself(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = join_tables(df, df, ["k"], lambda l, r: [l("k"), F.concat(l("v"), r("v")).alias("w")])
    assert sorted(map(tuple, got.collect())) == [(1, "aa"), (2, "bb")]


def test_latest_by_plans(spark):
    fixed = spark.createDataFrame([("a", 1, 2)], "symbol_pair string, seq long, v long")
    plan = latest_by(fixed, ["symbol_pair"], ["seq"])._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    two = merge_streams(fixed, fixed.drop("v"))
    assert two.columns == fixed.columns and two.count() == 2


def test_one_exchange_for_the_changelog(spark):
    from bandstream.operators.runs import Cuts

    log = logs.frame(spark, logs.random_log(1, 10))
    none = Cuts("symbol_pair")
    plan = join_changelog(log, cuts=none)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
