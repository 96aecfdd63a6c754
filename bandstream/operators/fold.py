"""The per-key fold: strict revisions, silence when nothing changes, drops.

An *entry* of a symbol starts with its first event after a drop (or ever) and
ends at the next drop.  What the entry holds before a row follows from running
maxima over the earlier rows of the symbol, because

* the accepted revisions of an entry are the strict records of its timestamps,
  so the current one is the earliest row that reaches the running maximum;
* an entry that a tick opened starts at timestamp 0, so only positive
  timestamps can be accepted there, and if the maximum is not positive none was;
* putting the entry's start in front of every ordering makes any value of a
  later entry beat all values of earlier ones, and a value whose start is not
  the current one belongs to an entry that is gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandstream.functions.numeric import add_band, same_value
from bandstream.functions.staging import compute_once
from bandstream.operators.latest import latest_by, merge_streams
from bandstream.operators.runs import TASK_ROWS, Cuts, Timeline, number_rows, timeline
from bandstream.schemas import FOLD_CHANGELOG

# Fixed value: records a sink writes at a time.
SINK_BATCH = 100

#: ``seq`` of seed rows; every log row has a greater one, negative ones too.
SEED_SEQ = -(1 << 63)


def is_config() -> Column:
    return (F.col("side") == "C") & ~F.coalesce("deleted", F.lit(False))


def is_drop() -> Column:
    return (F.col("side") == "C") & F.coalesce("deleted", F.lit(False))


def is_tick() -> Column:
    return F.col("side") == "P"


def seed_log(state: DataFrame) -> DataFrame:
    """Restored entries as log rows that come before everything else.

    ``state`` has symbol_pair, config_id, price, delta_percent and
    config_event_at.  The config row comes first, so that it is accepted
    whatever its timestamp.
    """
    config = state.select(
        "symbol_pair",
        F.lit(SEED_SEQ).cast("long").alias("seq"),
        F.lit("C").alias("side"),
        F.col("config_id").alias("id"),
        "delta_percent",
        "config_event_at",
        F.lit(False).alias("deleted"),
    )
    tick = state.where(F.col("price").isNotNull()).select(
        "symbol_pair",
        F.lit(SEED_SEQ + 1).cast("long").alias("seq"),
        F.lit("P").alias("side"),
        "price",
    )
    return merge_streams(config, tick)


def _known_keys(log: DataFrame, seed: DataFrame | None) -> DataFrame:
    rows = log.where(F.col("symbol_pair").isNotNull())
    return rows if seed is None else merge_streams(rows, seed_log(seed))


def _fold_timeline(
    log: DataFrame,
    seed: DataFrame | None,
    cuts: Cuts | None,
    limit: int,
) -> Timeline:
    line = timeline(_known_keys(log, seed), cuts=cuts, limit=limit)
    line = line.prior(_start=F.when(is_drop(), F.col("seq")))
    start = F.col("_start").alias("start")
    return line.prior(
        _first=F.when(
            ~is_drop(), F.struct(start, F.bitwise_not("seq").alias("earlier"), is_tick().alias("tick"))
        ),
        _revision=F.when(
            is_config(),
            F.struct(
                start,
                F.col("config_event_at").alias("at"),
                F.bitwise_not("seq").alias("earlier"),
                F.col("id").alias("config_id"),
                "delta_percent",
            ),
        ),
        _tick=F.when(is_tick(), F.struct(start, "seq", "price")),
    )


def _current(entry: str) -> Column:
    """The value, unless it belongs to an entry that was dropped since."""
    here = F.col(entry).isNotNull() & F.col(f"{entry}.start").eqNullSafe(F.col("_start"))
    return F.when(here, F.col(entry))


def fold_steps(log: DataFrame, seed: DataFrame | None = None, **sizes) -> DataFrame:
    """Every log row with the entry before it and what it does to the entry.

    ``accepted``: the revision was taken, or the row is a tick or a drop of a
    known symbol.  ``changed``: a scaled value is different from before.
    """
    steps = _all_steps(log, seed, **sizes)
    return steps if seed is None else steps.where(F.col("seq") > SEED_SEQ + 1)


def _all_steps(
    log: DataFrame,
    seed: DataFrame | None,
    cuts: Cuts | None = None,
    limit: int = TASK_ROWS,
) -> DataFrame:
    rows = _fold_timeline(log, seed, cuts, limit).rows()
    by_tick = F.coalesce(_current("_first")["tick"], F.lit(False))
    # an entry opened by a tick is at time 0: what is not above that was refused
    refused = by_tick & (_current("_revision")["at"] <= 0)
    config, tick = F.col("_revision_own"), F.col("_tick_own")
    rows = compute_once(
        rows.select(
            "symbol_pair",
            "seq",
            "_start",
            "_first",
            "_revision",
            "_tick",
            "_revision_own",
            "_tick_own",
        ),
        {
            "event": F.when(config.isNotNull(), "config")
            .when(tick.isNotNull(), "tick")
            .otherwise("drop"),
            "_known": _current("_first").isNotNull(),
            "_by_tick": by_tick,
            "_config": F.when(~F.coalesce(refused, F.lit(False)), _current("_revision")),
            "old_price": _current("_tick")["price"],
        },
    )
    is_revision, is_price = F.col("event") == "config", F.col("event") == "tick"
    zero = F.lit(0).cast("long")
    base = F.when(F.col("_by_tick"), F.coalesce("_config.at", zero)).otherwise(
        F.col("_config.at")
    )
    taken = base.isNull() | (config["at"] > base)
    old_delta = F.col("_config.delta_percent")
    rows = compute_once(
        rows,
        {
            "accepted": F.when(is_revision, taken).when(is_price, True).otherwise(F.col("_known")),
            "changed": F.when(is_revision, taken & ~same_value(old_delta, config["delta_percent"]))
            .when(is_price, ~same_value(F.col("old_price"), tick["price"]))
            .otherwise(F.col("_known")),
            "old_delta": old_delta,
        },
    )
    replaced = is_revision & F.col("accepted")
    now = F.when(replaced, config).otherwise(F.col("_config"))
    return rows.select(
        "symbol_pair",
        "seq",
        "event",
        "accepted",
        "changed",
        "old_price",
        "old_delta",
        F.when(is_price, tick["price"]).otherwise(F.col("old_price")).alias("new_price"),
        F.when(replaced, config["delta_percent"]).otherwise(F.col("old_delta")).alias("new_delta"),
        now["config_id"].alias("new_config_id"),
        F.coalesce(now["at"], zero).alias("new_config_event_at"),
    )


def fold_changelog(log: DataFrame, seed: DataFrame | None = None, **sizes) -> DataFrame:
    """What the fold emits: U for a changed complete entry, D for dropping one.

    A D row carries the values the entry had.
    """
    steps = fold_steps(log, seed, **sizes)
    complete = F.col("new_price").isNotNull() & F.col("new_delta").isNotNull()
    emitted = steps.where(F.col("changed") & complete).select(
        "symbol_pair",
        F.col("new_config_id").alias("config_id"),
        F.col("new_price").alias("price"),
        F.col("new_delta").alias("delta_percent"),
        F.col("new_config_event_at").alias("config_event_at"),
        F.when(F.col("event") == "drop", "D").otherwise("U").alias("op"),
        "seq",
    )
    return add_band(emitted).select(*FOLD_CHANGELOG.names)


def fold_state(log: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """All entries at the end of the log, complete (``presented``) or not.

    Needs no order of the rows: what counts is after the last drop of its
    symbol, and of that only the first row, the highest revision and the last
    tick, all of them aggregates that combine before they shuffle.
    """
    rows = _known_keys(log, seed)
    drops = rows.where(is_drop()).groupBy("symbol_pair").agg(F.max("seq").alias("_dropped"))
    since = rows.join(drops, "symbol_pair", "left").where(
        F.col("_dropped").isNull() | (F.col("seq") > F.col("_dropped"))
    )
    revision = F.struct(
        F.col("config_event_at").alias("at"),
        F.bitwise_not("seq").alias("earlier"),
        F.col("id").alias("config_id"),
        "delta_percent",
    )
    entries = since.groupBy("symbol_pair").agg(
        F.min(F.struct("seq", is_tick().alias("tick"))).alias("_first"),
        F.max(F.when(is_config(), revision)).alias("_revision"),
        F.max(F.when(is_tick(), F.struct("seq", "price"))).alias("_tick"),
    )
    # an entry opened by a tick is at time 0: what is not above that was refused
    refused = F.col("_first.tick") & (F.col("_revision.at") <= 0)
    taken = F.when(~F.coalesce(refused, F.lit(False)), F.col("_revision"))
    staged = entries.select(
        "symbol_pair",
        taken["config_id"].alias("config_id"),
        F.col("_tick.price").alias("price"),
        taken["delta_percent"].alias("delta_percent"),
        F.coalesce(taken["at"], F.lit(0).cast("long")).alias("config_event_at"),
    )
    return add_band(staged).select(
        "symbol_pair",
        "config_id",
        "price",
        "delta_percent",
        "low_price",
        "high_price",
        (F.col("price").isNotNull() & F.col("delta_percent").isNotNull()).alias("presented"),
        F.lit(False).alias("deleted"),
        "config_event_at",
    )


def fold_snapshot(state: DataFrame) -> DataFrame:
    return state.where(F.col("presented") & ~F.col("deleted"))


def sink_batches(changelog: DataFrame, size: int = SINK_BATCH) -> DataFrame:
    """Number the emitted rows by ``seq`` and group each ``size`` into a batch."""
    numbered = number_rows(changelog)
    return numbered.withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def project_fold_batches(changelog: DataFrame, size: int = SINK_BATCH) -> DataFrame:
    """The projection after sink batches that save all upserts, then delete.

    Inside a batch a delete wins over any upsert; across batches the last one
    that has the symbol wins.  Both rules are one ordering, so one aggregate
    answers.
    """
    batches = sink_batches(changelog, size)
    ranked = batches.withColumn("_delete", F.col("op") == "D")
    last = latest_by(ranked, ["symbol_pair"], ["batch", "_delete", "seq"])
    return last.where(~F.col("_delete")).drop("_delete", "position", "batch", "op")


def restore_seed(cache: DataFrame, configs: DataFrame) -> DataFrame:
    """Seed rows for a restart: the cached entries if any, else the config table.

    ``cache`` is a projection of the fold; ``configs`` has id, symbol_pair,
    delta_percent and config_event_at.
    """
    columns = ["symbol_pair", "config_id", "price", "delta_percent", "config_event_at"]
    cached = cache.where(
        F.col("symbol_pair").isNotNull() & ~F.col("symbol_pair").endswith(":phantom")
    )
    if not cached.isEmpty():
        return cached.select(*columns)
    return configs.select(
        "symbol_pair",
        F.col("id").alias("config_id"),
        F.lit(None).cast("decimal(24,8)").alias("price"),
        "delta_percent",
        "config_event_at",
    )


def reconcile_log(log: DataFrame, configs: DataFrame, after: Column) -> DataFrame:
    """Append the whole config table to the log as fresh config events.

    Revisions the fold already has are rejected by its own rule, so this only
    repairs what was missed.  ``after`` gives each row its ``seq``.
    """
    events = configs.withColumns(
        {"side": F.lit("C"), "seq": after, "deleted": F.lit(False)}
    )
    return merge_streams(log, events)


__all__ = [
    "SINK_BATCH",
    "fold_changelog",
    "fold_snapshot",
    "fold_state",
    "fold_steps",
    "project_fold_batches",
    "reconcile_log",
    "restore_seed",
    "seed_log",
    "sink_batches",
]
