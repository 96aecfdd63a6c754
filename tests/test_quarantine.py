"""Two outputs of one stream, and a table that changes while it is looked up."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.session import scratch_path
from bandstream.sources import cdc, fixtures
from bandstream.sources.store import CompactedChangelog
from bandstream.streaming import sinks

SF = "/root/testdata/sf0.001"


def text(df):
    return sorted(map(str, df.collect()))


def test_both_outputs_after_a_repeated_batch(spark):
    raw = fixtures.cdc_log(spark, SF)
    events = CompactedChangelog(spark, scratch_path(spark, "e"), cdc.parse_cdc(raw).schema)
    rejects = CompactedChangelog(spark, scratch_path(spark, "r"), cdc.cdc_rejects(raw).schema)
    write = sinks.quarantine_into(events, rejects)
    pieces = [raw.where("offset < 100"), raw.where("offset >= 100")]
    for batch_id in (0, 1, 1):
        write(pieces[batch_id], batch_id)
    assert text(events.changes().drop("batch_id")) == text(cdc.parse_cdc(raw))
    assert text(rejects.changes().drop("batch_id")) == text(cdc.cdc_rejects(raw))
    assert rejects.changes().count() > 0


def test_changes_of_the_table_show_in_the_next_batch(spark):
    row = lambda price: spark.range(1).select(
        F.lit("A").alias("symbol_pair"), F.lit(price).alias("last")
    )
    held = [1]
    shape = T.StructType.fromDDL("symbol_pair string, seq long, last int")
    store = CompactedChangelog(spark, scratch_path(spark, "s"), shape)
    write = sinks.enrich_into(store, lambda: row(held[0]))
    ticks = spark.createDataFrame([("A", 1), ("B", 2)], "symbol_pair string, seq long")
    write(ticks, 0)
    held[0] = 5
    write(ticks, 1)
    got = sorted((r["batch_id"], r["symbol_pair"], r["last"]) for r in store.changes().collect())
    assert got == [(0, "A", 1), (0, "B", None), (1, "A", 5), (1, "B", None)]
