"""The registered queries: each operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.functions import text
from bandstream.functions.numeric import add_band, as_delta, as_price
from bandstream.operators import fold, joins, latest, mutations, projection, push
from bandstream.operators.ticks import tick_direction
from bandstream.schemas import (
    CHANGELOG,
    CONFIG_EVENT,
    CONFIG_EVENT_WIRE,
    FOLD_CHANGELOG,
    TAGGED_LOG,
)
from bandstream.session import configure, scratch_path, stored
from bandstream.sources import cdc, fixtures, records, tables
from bandstream.sources.store import CompactedChangelog
from bandstream.streaming import changelogs, sinks
from bandstream.streaming.keyed import KeyedState

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DAY = fixtures.DAY_MS
MID_JANUARY = 1_705_276_800_000  # 2024-01-15 00:00 UTC
YEAR_1995 = 788_918_400_000
PUBLISHED_AT = 1_704_067_200_000
SPLIT_ROWS = 60
INDEX_ROWS = 1000


def plain(df: DataFrame) -> DataFrame:
    """Decimals as text with eight decimals, so that both engines show every digit."""
    return df.select(
        *[
            F.col(f.name).cast("decimal(38,8)").cast("string").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return plain(fn(spark, sf_dir))

    REGISTRY[fn.__name__] = run
    return fn


# --- scans -------------------------------------------------------------------


@query
def cdc_scan(spark, sf_dir):
    return fixtures.cdc_log(spark, sf_dir).select(
        "topic",
        "partition",
        "offset",
        F.unix_millis("timestamp").alias("at"),
        "key",
        "value",
        F.size("headers").alias("headers"),
    )


def _snapshot_records(spark, sf_dir):
    events = tables.to_config_events(fixtures.config_table(spark, sf_dir))
    return records.publish_snapshot(events)


@query
def snapshot_scan(spark, sf_dir):
    return records.snapshot_scan(_snapshot_records(spark, sf_dir))


@query
def price_table(spark, sf_dir):
    published = records.to_records(
        fixtures.order_ticks(spark, sf_dir), records.PRICE_TOPIC, records.MARKET_PRICE_WIRE
    )
    return latest.latest_price(records.price_scan(published)).drop("deleted")


def _changelog(spark, sf_dir):
    return joins.join_changelog(fixtures.log(spark, sf_dir))


@query
def changelog_scan(spark, sf_dir):
    return records.changelog_scan(records.changelog_records(_changelog(spark, sf_dir)))


@query
def global_scan(spark, sf_dir):
    read_back = records.changelog_scan(records.changelog_records(_changelog(spark, sf_dir)))
    return projection.by_symbol(latest.live_rows(read_back).drop("seq"))


@query
def config_list(spark, sf_dir):
    return tables.config_list(fixtures.config_table(spark, sf_dir)).withColumn(
        "updated_at", text.epoch_millis(F.col("updated_at"))
    )


@query
def config_lookup(spark, sf_dir):
    keys = (
        fixtures.read(spark, sf_dir, "orders")
        .select(F.concat(F.lit("S"), F.col("o_custkey") * 2).alias("symbol_pair"))
        .distinct()
    )
    found = tables.lookup(fixtures.config_table(spark, sf_dir), keys)
    return found.select("symbol_pair", "id", "delta_percent", "found")


@query
def outbox_incremental(spark, sf_dir):
    """Two increments: everything, then what came after the first read."""
    outbox = fixtures.outbox(spark, sf_dir)
    half = outbox.agg(F.max("id")).first()[0] // 2
    first = outbox.where(F.col("id") <= half).withColumn("increment", F.lit(1))
    second = cdc.outbox_after(outbox, half).withColumn("increment", F.lit(2))
    return first.unionByName(second).select("increment", "id", "event_id", "type", "aggregateid")


def _written():
    return F.greatest("price_at", "config_event_at")


@query
def projection_scan(spark, sf_dir):
    rows = latest.live_rows(_changelog(spark, sf_dir))
    shadow = rows.withColumn("symbol_pair", F.concat("symbol_pair", F.lit(":phantom")))
    stored = projection.with_ttl(rows.unionByName(shadow), _written(), ttl_ms=2 * DAY)
    return projection.alive(stored, MID_JANUARY + 14 * DAY).drop("seq")


@query
def bad_records(spark, sf_dir):
    raw = fixtures.cdc_log(spark, sf_dir)
    return records.bad_records(raw, CONFIG_EVENT, CONFIG_EVENT_WIRE).select(
        "offset", "key", "value"
    )


# --- sinks -------------------------------------------------------------------


@query
def changelog_sink(spark, sf_dir):
    return records.changelog_records(_changelog(spark, sf_dir))


def _line_log(spark, sf_dir):
    return latest.tag_log(
        fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
    )


@query
def compact(spark, sf_dir):
    """Changelog of all line ticks, stored in two batches; the first is compacted."""
    changes = joins.join_changelog(_line_log(spark, sf_dir))
    middle = fixtures.line_ticks(spark, sf_dir).agg(F.avg("seq")).first()[0]
    store = CompactedChangelog(spark, scratch_path(spark, "compact"), CHANGELOG)
    late = (F.col("seq") > middle).cast("long")
    store.append_batches(changes.withColumn("batch", late), "batch", [0, 1])
    store.compact(upto=0)
    return store.read().drop("seq")


@query
def publish_snapshot(spark, sf_dir):
    return _snapshot_records(spark, sf_dir)


@query
def publish_prices(spark, sf_dir):
    return records.publish_prices(
        fixtures.order_ticks(spark, sf_dir), F.lit(PUBLISHED_AT).cast("long")
    )


@query
def project_collapse(spark, sf_dir):
    batches = push.poll_batches(_changelog(spark, sf_dir))
    return latest.collapse(batches.drop("position"), "batch")


@query
def project_fold_batches(spark, sf_dir):
    changes = fold.fold_changelog(fixtures.log(spark, sf_dir))
    return fold.project_fold_batches(changes)


@query
def push_payload(spark, sf_dir):
    return push.push_payload(push.poll_batches(_changelog(spark, sf_dir)))


@query
def push_payload_fold(spark, sf_dir):
    return push.push_payload_fold(fold.fold_changelog(fixtures.log(spark, sf_dir)))


@query
def push_envelope(spark, sf_dir):
    payloads = push.push_payload(push.poll_batches(_changelog(spark, sf_dir)))
    return push.push_envelope(payloads).withColumn("data", F.sha2("data", 256))


@query
def outbox_route(spark, sf_dir):
    routed = cdc.route_outbox(fixtures.outbox(spark, sf_dir))
    return routed.select(
        "topic",
        "key",
        "value",
        "offset",
        cdc.last_header(F.col("headers"), cdc.ID_HEADER).alias("id_header"),
        cdc.last_header(F.col("headers"), cdc.TYPE_HEADER).alias("type_header"),
    )


# --- change data capture -----------------------------------------------------


@query
def cdc_parse(spark, sf_dir):
    return cdc.parse_cdc(fixtures.cdc_log(spark, sf_dir))


@query
def cdc_header(spark, sf_dir):
    return fixtures.cdc_log(spark, sf_dir).select(
        "offset",
        cdc.last_header(F.col("headers"), cdc.TYPE_HEADER).alias("event_type"),
        cdc.last_header(F.col("headers"), cdc.ID_HEADER).alias("event_id"),
    )


@query
def cdc_type_map(spark, sf_dir):
    kind = cdc.last_header(F.col("headers"), cdc.TYPE_HEADER)
    typed = fixtures.cdc_log(spark, sf_dir).select(
        "offset", kind.alias("event_type"), cdc.deleted_flag(kind).alias("deleted")
    )
    return typed.where(F.col("deleted").isNotNull())


@query
def cdc_unwrap(spark, sf_dir):
    rows = cdc.raw_fields(fixtures.cdc_log(spark, sf_dir))
    return rows.where("_json").select(
        "offset",
        F.col("_id").alias("id"),
        F.col("_symbol").alias("symbol_pair"),
        F.col("_delta").try_cast("double").alias("delta_percent"),
        F.col("_at").alias("updated_at"),
    )


@query
def cdc_fields(spark, sf_dir):
    return cdc.classify(fixtures.cdc_log(spark, sf_dir)).select(
        "offset", "id", "symbol_pair", "delta_percent", "config_event_at"
    )


@query
def cdc_rejects(spark, sf_dir):
    return cdc.cdc_rejects(fixtures.cdc_log(spark, sf_dir))


@query
def rekey(spark, sf_dir):
    events = cdc.parse_cdc(fixtures.cdc_log(spark, sf_dir))
    return latest.rekey(events, F.col("symbol_pair")).select("key", "id", "seq")


# --- keyed tables ------------------------------------------------------------


@query
def latest_config(spark, sf_dir):
    return latest.latest_config(fixtures.log_configs(spark, sf_dir))


@query
def active_configs(spark, sf_dir):
    return latest.active_configs(latest.latest_config(fixtures.log_configs(spark, sf_dir)))


@query
def latest_price(spark, sf_dir):
    return latest.latest_price(fixtures.line_ticks(spark, sf_dir))


@query
def merge_config_streams(spark, sf_dir):
    captured = cdc.parse_cdc(fixtures.cdc_log(spark, sf_dir))
    snapshot = records.snapshot_scan(_snapshot_records(spark, sf_dir))
    return latest.latest_config(latest.merge_streams(captured, snapshot))


@query
def collapse(spark, sf_dir):
    return latest.collapse(_changelog(spark, sf_dir))


@query
def batch_metrics(spark, sf_dir):
    return sinks.batch_metrics(push.poll_batches(_changelog(spark, sf_dir)).drop("position"))


# --- joins -------------------------------------------------------------------


@query
def full_config_snapshot(spark, sf_dir):
    return joins.full_config(
        fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
    )


@query
def full_config_changelog(spark, sf_dir):
    return _changelog(spark, sf_dir)


@query
def full_config_line_changelog(spark, sf_dir):
    return joins.join_changelog(_line_log(spark, sf_dir))


def _shown(table: DataFrame) -> DataFrame:
    return table.select(
        "symbol_pair", "config_id", F.col("price").alias("last_price"), "low_price", "high_price"
    )


@query
def enrich_with_full_config(spark, sf_dir):
    table = joins.join_state(fixtures.log(spark, sf_dir)).where(F.col("op") == "U")
    return joins.enrich(fixtures.order_ticks(spark, sf_dir), _shown(table))


# --- the fold ----------------------------------------------------------------


@query
def fold_accept(spark, sf_dir):
    steps = fold.fold_steps(fixtures.log(spark, sf_dir))
    return steps.select("symbol_pair", "seq", "event", "accepted")


@query
def fold_changes(spark, sf_dir):
    steps = fold.fold_steps(fixtures.log(spark, sf_dir))
    return steps.where(F.col("changed") & (F.col("event") != "drop")).select(
        "symbol_pair", "seq", "event", "old_price", "old_delta", "new_price", "new_delta"
    )


@query
def fold_changelog(spark, sf_dir):
    return fold.fold_changelog(fixtures.log(spark, sf_dir))


@query
def fold_state(spark, sf_dir):
    return fold.fold_state(fixtures.log(spark, sf_dir))


@query
def fold_snapshot(spark, sf_dir):
    return fold.fold_snapshot(fold.fold_state(fixtures.log(spark, sf_dir)))


@query
def fold_restore(spark, sf_dir):
    """Fold the first half, restart from its cached entries, fold the second."""
    before, after = _halves(spark, sf_dir)
    cache = fold.fold_snapshot(fold.fold_state(before))
    configs = tables.to_config_events(fixtures.config_table(spark, sf_dir))
    return fold.fold_changelog(after, seed=fold.restore_seed(cache, configs))


@query
def fold_rebuild(spark, sf_dir):
    """Start without cached entries: from the config table."""
    cache = spark.createDataFrame([], FOLD_CHANGELOG)
    configs = tables.to_config_events(fixtures.config_table(spark, sf_dir))
    seed = fold.restore_seed(cache, configs)
    return fold.fold_changelog(fixtures.log(spark, sf_dir), seed=seed)


@query
def fold_reconcile(spark, sf_dir):
    log = fixtures.log(spark, sf_dir)
    configs = tables.to_config_events(fixtures.config_table(spark, sf_dir)).drop("seq")
    last = log.agg(F.max("seq")).first()[0]
    return fold.fold_changelog(fold.reconcile_log(log, configs, F.col("id") + F.lit(last + 1)))


# --- reads -------------------------------------------------------------------


@query
def tick_directions(spark, sf_dir):
    return tick_direction(fixtures.order_ticks(spark, sf_dir))


REGISTRY["tick_direction"] = REGISTRY.pop("tick_directions")


@query
def page(spark, sf_dir):
    table = joins.full_config(
        fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
    )
    return projection.page(table, number=2, size=20, sort="price", desc=True)


@query
def page_after(spark, sf_dir):
    """The page after the last row of the first 40, from a stored table."""
    table = stored(
        joins.full_config(
            fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
        ),
        "projection",
    )
    last = projection.page(table, number=39, size=1, sort="price", desc=True).first()
    after = (last["price"], last["symbol_pair"]) if last else None
    return projection.page_after(table, after, size=20, sort="price", desc=True)


@query
def page_indexed(spark, sf_dir):
    """The third, the middle and the last page of a stored index, with their ``number``."""
    table = joins.full_config(
        fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
    )
    index = projection.PageIndex(
        spark, scratch_path(spark, "pages"), table.schema, block_rows=INDEX_ROWS
    )
    index.write(table, sort="price", desc=True)
    last = projection.page_meta(index.rows()).first()["total_pages"] - 1
    numbers = sorted({2, last // 2, last})
    pages = [index.page(n).withColumn("number", F.lit(n)) for n in numbers if n >= 0]
    return reduce(DataFrame.unionByName, pages)


@query
def page_meta(spark, sf_dir):
    table = joins.full_config(
        fixtures.part_configs(spark, sf_dir), fixtures.line_ticks(spark, sf_dir)
    )
    return projection.page_meta(table, number=2, size=20)


@query
def projection_ttl(spark, sf_dir):
    as_of = MID_JANUARY + 14 * DAY
    return projection.project(
        _changelog(spark, sf_dir), _written(), as_of, ttl_ms=2 * DAY
    ).drop("seq")


@query
def projection_ttl_renewed(spark, sf_dir):
    as_of = MID_JANUARY + 10 * DAY
    return projection.project(
        _changelog(spark, sf_dir),
        _written(),
        as_of,
        ttl_ms=3 * DAY,
        renew_ms=DAY // 2,
        renew_from=PUBLISHED_AT,
        renew_until=MID_JANUARY + 8 * DAY,
    ).drop("seq")


# --- scalar functions --------------------------------------------------------


@query
def scale_values(spark, sf_dir):
    fraction = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    return fixtures.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        as_price(F.round(fraction, 4).cast("decimal(38,10)")).alias("price"),
        as_delta((F.col("l_partkey") / 4).cast("decimal(38,10)")).alias("delta_percent"),
    )


@query
def band(spark, sf_dir):
    """Bands wide enough that the 16-digit rounding shows."""
    scaled = F.col("l_extendedprice").cast("decimal(12,2)") * F.lit("10007.12345").cast(
        "decimal(10,5)"
    )
    delta = F.col("l_quantity").cast("decimal(5,0)") + F.col("l_tax").cast("decimal(4,2)") * F.lit(
        "1.0101"
    ).cast("decimal(5,4)")
    rows = fixtures.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        as_price(scaled).alias("price"),
        as_delta(delta).alias("delta_percent"),
    )
    return add_band(rows)


@query
def format_price(spark, sf_dir):
    value = F.col("l_extendedprice").cast("decimal(24,8)") * F.col("l_discount").cast(
        "decimal(4,2)"
    ) * F.col("l_tax").cast("decimal(4,2)")
    return fixtures.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        text.format_price(as_price(value)).alias("shown"),
    )


@query
def base_symbol(spark, sf_dir):
    name = F.translate("p_name", " ", "-")
    return fixtures.read(spark, sf_dir, "part").select(
        "p_partkey", text.base_symbol(name).alias("base")
    )


@query
def normalise_symbol(spark, sf_dir):
    typed = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return fixtures.read(spark, sf_dir, "part").select(
        "p_partkey", text.normalise_symbol(typed).alias("symbol")
    )


@query
def format_time(spark, sf_dir):
    kept = F.when(F.col("event_type") != "error", text.epoch_millis(F.col("ts")))
    return fixtures.read(spark, sf_dir, "events").select(
        "event_id", text.format_time(kept).alias("shown")
    )


# --- mutations ---------------------------------------------------------------


@query
def validation_errors(spark, sf_dir):
    return mutations.validation_errors(fixtures.requests(spark, sf_dir))


def _applied(spark, sf_dir, log=fixtures.requests):
    return mutations.apply_requests(
        fixtures.config_table(spark, sf_dir),
        log(spark, sf_dir),
        F.timestamp_millis(F.col("seq") * 1000 + MID_JANUARY),
        F.concat(F.lit("e-"), F.col("seq")),
    )


@query
def mutation_results(spark, sf_dir):
    return _applied(spark, sf_dir).results


@query
def mutation_table(spark, sf_dir):
    table = _applied(spark, sf_dir).configs
    return table.withColumn("updated_at", text.epoch_millis(F.col("updated_at")))


@query
def mutation_fresh_results(spark, sf_dir):
    return _applied(spark, sf_dir, fixtures.fresh_requests).results


@query
def mutation_fresh_table(spark, sf_dir):
    table = _applied(spark, sf_dir, fixtures.fresh_requests).configs
    return table.withColumn("updated_at", text.epoch_millis(F.col("updated_at")))


@query
def outbox_rows(spark, sf_dir):
    return _applied(spark, sf_dir).outbox


# --- streams -----------------------------------------------------------------


def _run(spark, sf_dir, build, schema, stages) -> CompactedChangelog:
    """Stream logs into a store; after each one the query stops and resumes."""
    source = scratch_path(spark, "arrivals")
    progress = scratch_path(spark, "progress")
    store = CompactedChangelog(spark, scratch_path(spark, "changes"), schema)
    for rows in stages:
        rows.select(*TAGGED_LOG.names).write.mode("append").parquet(source)
        stream = build(records.file_stream(spark, source, TAGGED_LOG))
        sinks.start(
            stream, sinks.append_into(store), progress, available_now=True
        ).awaitTermination()
    return store


def _halves(spark, sf_dir) -> list[DataFrame]:
    events = fixtures.read(spark, sf_dir, "events")
    middle = F.timestamp_millis(F.lit(MID_JANUARY)).cast("timestamp_ntz")
    return [
        fixtures.log_view(events.where(F.col("ts") < middle)),
        fixtures.log_view(events.where(F.col("ts") >= middle)),
    ]


@query
def stream_full_config(spark, sf_dir):
    return _run(spark, sf_dir, joins.join_state, CHANGELOG, _halves(spark, sf_dir)).read()


def _run_per_event(spark, sf_dir, into, schema, state_schema) -> DataFrame:
    """Stream both halves, each cut along time into three micro-batches of the log."""
    source, progress = scratch_path(spark, "arrivals"), scratch_path(spark, "progress")
    changes = CompactedChangelog(spark, scratch_path(spark, "changes"), schema)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = KeyedState(spark, scratch_path(spark, "state"), state_schema, buckets=buckets)
    for half in _halves(spark, sf_dir):
        rows = half.select(*TAGGED_LOG.names)
        # ranges of seq become files that arrive one after the other
        cuts = rows.approxQuantile("seq", [1 / 3, 2 / 3], 0.01)
        low = None
        for high in [*cuts, None]:
            piece = rows if low is None else rows.where(F.col("seq") > low)
            piece = piece if high is None else piece.where(F.col("seq") <= high)
            piece.write.mode("append").parquet(source)
            stream = records.file_stream(spark, source, TAGGED_LOG)
            sinks.start(
                stream, into(changes, state), progress, mode="append", available_now=True
            ).awaitTermination()
            low = high
    return changes.changes().drop("batch_id")


@query
def stream_changelog(spark, sf_dir):
    return _run_per_event(spark, sf_dir, changelogs.join_into, CHANGELOG, changelogs.JOIN_STATE)


@query
def stream_fold_changelog(spark, sf_dir):
    return _run_per_event(
        spark, sf_dir, changelogs.fold_into, FOLD_CHANGELOG, changelogs.FOLD_STATE
    )


@query
def stream_cdc_to_table(spark, sf_dir):
    """Captured messages and ticks, streamed from topic rows to the stored table."""
    source, prices = scratch_path(spark, "cdc"), scratch_path(spark, "ticks")
    store = CompactedChangelog(spark, scratch_path(spark, "table"), CHANGELOG)
    fixtures.cdc_log(spark, sf_dir).write.parquet(source)
    ticks = fixtures.order_ticks(spark, sf_dir)
    ticks.write.parquet(prices)
    configs = cdc.parse_cdc(records.file_stream(spark, source))
    log = latest.tag_log(configs, records.file_stream(spark, prices, ticks.schema))
    sinks.start(
        joins.join_state(log),
        sinks.project_into(store),
        scratch_path(spark, "progress"),
        available_now=True,
    ).awaitTermination()
    return store.read().drop("seq")


@query
def stream_cdc_quarantine(spark, sf_dir):
    """Captured messages in micro-batches of two files; both outputs, ``reason`` tells them apart."""
    source, progress = scratch_path(spark, "cdc"), scratch_path(spark, "progress")
    raw = fixtures.cdc_log(spark, sf_dir)
    raw.repartition(8, "offset").write.parquet(source)
    events = CompactedChangelog(spark, scratch_path(spark, "events"), cdc.parse_cdc(raw).schema)
    rejects = CompactedChangelog(
        spark, scratch_path(spark, "rejects"), cdc.cdc_rejects(raw).schema
    )
    stream = records.file_stream(spark, source, raw.schema, max_files=2)
    each = sinks.quarantine_into(events, rejects)
    sinks.start(stream, each, progress, "append", available_now=True).awaitTermination()
    both = events.changes().unionByName(rejects.changes(), allowMissingColumns=True)
    return both.drop("batch_id")


@query
def stream_enrich(spark, sf_dir):
    """Ticks up to 1994 meet the table of the first half of the log, later ones the whole."""
    log, ticks = scratch_path(spark, "log"), scratch_path(spark, "ticks")
    progress = [scratch_path(spark, "progress") for _ in range(2)]
    table = CompactedChangelog(spark, scratch_path(spark, "table"), CHANGELOG)
    arrivals = fixtures.order_ticks(spark, sf_dir)
    shape = joins.enrich(arrivals, _shown(table.spark.createDataFrame([], CHANGELOG))).schema
    store = CompactedChangelog(spark, scratch_path(spark, "enriched"), shape)
    early = F.col("price_at") < YEAR_1995
    for half, due in zip(_halves(spark, sf_dir), (early, ~early)):
        half.select(*TAGGED_LOG.names).write.mode("append").parquet(log)
        changes = joins.join_state(records.file_stream(spark, log, TAGGED_LOG))
        sinks.start(
            changes, sinks.append_into(table), progress[0], available_now=True
        ).awaitTermination()
        arrivals.where(due).write.mode("append").parquet(ticks)
        sinks.start(
            records.file_stream(spark, ticks, arrivals.schema),
            sinks.enrich_into(store, lambda: _shown(table.read())),
            progress[1],
            "append",
            available_now=True,
        ).awaitTermination()
    return store.changes().drop("batch_id")


@query
def full_config_changelog_split(spark, sf_dir):
    """With a task limit so low that the busiest symbols are cut into segments."""
    return joins.join_changelog(fixtures.log(spark, sf_dir), limit=SPLIT_ROWS)


@query
def fold_changelog_split(spark, sf_dir):
    return fold.fold_changelog(fixtures.log(spark, sf_dir), limit=SPLIT_ROWS)


@query
def bootstrap_equivalence(spark, sf_dir):
    """Seed both sides from full snapshots, then stream the log on top."""
    configs = tables.to_config_events(fixtures.config_table(spark, sf_dir))
    prices = fixtures.order_ticks(spark, sf_dir).withColumn(
        "seq", F.col("seq") - F.lit(1 << 40)
    )
    seeded = latest.tag_log(configs, prices.withColumn("deleted", F.lit(False)))
    stages = [seeded, fixtures.log(spark, sf_dir)]
    return _run(spark, sf_dir, joins.join_state, CHANGELOG, stages).read().drop("seq")


__all__ = ["REGISTRY", "plain", "query"]
