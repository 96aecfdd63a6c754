"""Create, update and delete requests against the config table, as one job.

The requests of a log take effect one after the other in ``seq`` order, and
whether one succeeds depends on the ones before it.  The job does not replay
them.  It guesses every outcome, derives the outcomes that follow, and repeats
until none changes.  Outcome ``n`` depends on earlier outcomes only, so each round
settles at least the first request that was still wrong, and a log without changes
left is the sequential result.

**Within a symbol** a round is exact, however long the chain.  A request that takes
a free symbol holds it until its row leaves; who gets it next is the first request
to ask for it after that, which needs no knowledge of what came before.  These
pointers form chains; the one that begins at the first holder is followed with
pointers of doubled length, so a chain of n holders needs log n steps, and pointers
that pass its end leave the loop.  Only a rename, which changes two symbols at once,
carries a guess from one symbol to another.

**Ids made by the log itself** are guessed as well: the last id of the table plus
the running count of creates that are guessed to succeed.  A request that names such
an id belongs to the create which has it in the round at hand.

A round reads again only what the last one can have changed: requests of the symbols
that a row with a changed guess names anywhere.

**Slices.** One wrong guess about a create shifts all later ids, so over a whole log
the rounds would grow with its length, and nearly all of it would be judged in each.  A
long log that names such ids is cut by ``seq`` into slices, each ``GROWTH`` times as long
as all earlier ones; a slice starts from the table the earlier ones left, where the
ids they made are known.  Any borders give the same outcomes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandstream.operators.latest import latest_by
from bandstream.operators.runs import TASK_ROWS, Cuts, hot_cuts, number_rows, timeline
from bandstream.schemas import DELTA
from bandstream.session import scratch_path, stored

# Limits, messages, statuses, error codes, event types.
MAX_SYMBOL = 32
MAX_INTEGER, MAX_FRACTION = 3, 6
BLANK = "must not be blank"
SIZE = f"size must be between 0 and {MAX_SYMBOL}"
NULL = "must not be null"
NEGATIVE = "must be greater than or equal to 0"
DIGITS = (
    f"numeric value out of bounds (<{MAX_INTEGER} digits>.<{MAX_FRACTION} digits> expected)"
)
OK_STATUS = {"create": 201, "update": 200, "delete": 204}
EVENT = {
    "create": "PriceConfigCreated",
    "update": "PriceConfigUpdated",
    "delete": "PriceConfigDeleted",
}
AGGREGATE_TYPE = "PRICE_CONFIG"

#: Before every request; ``seq`` lies above it.
BEGIN = -(1 << 62)
#: Pointers that one step of the doubling follows in a row.
HOPS = 4
#: Requests of the first slice of a log that names ids of its own, and how many times
#: all earlier ones together a later slice has.
FIRST_SLICE, GROWTH = 1_000_000, 3


def field_errors() -> dict[str, Column]:
    """First broken rule per field of a create or update, null when it is fine."""
    symbol, delta = F.col("symbol_pair"), F.col("delta_percent")
    blank = symbol.isNull() | symbol.rlike(r"^[\x00-\x20]*$")
    digits = (F.abs(delta) >= 10**MAX_INTEGER) | (delta != F.round(delta, MAX_FRACTION))
    checked = F.col("op") != "delete"
    return {
        "symbolPair": F.when(
            checked, F.when(blank, BLANK).when(F.length(symbol) > MAX_SYMBOL, SIZE)
        ),
        "deltaPercent": F.when(
            checked,
            F.when(delta.isNull(), NULL).when(delta < 0, NEGATIVE).when(digits, DIGITS),
        ),
    }


def validation_errors(requests: DataFrame) -> DataFrame:
    """One row per request and broken field: seq, field, message."""
    pairs = [
        F.when(message.isNotNull(), F.struct(F.lit(name).alias("field"), message.alias("message")))
        for name, message in field_errors().items()
    ]
    errors = F.explode(F.array_compact(F.array(*pairs)))
    return requests.select("seq", errors.alias("_error")).select("seq", "_error.*")


@dataclass(frozen=True)
class Applied:
    configs: DataFrame
    results: DataFrame
    #: Requests judged in each round.
    work: tuple[int, ...]
    #: Steps of pointer doubling, over all rounds.
    steps: int
    numbered_outbox: Callable[[], DataFrame]

    @cached_property
    def outbox(self) -> DataFrame:
        """Made when it is asked for, since numbering sorts all events."""
        return self.numbered_outbox()

    @property
    def rounds(self) -> int:
        return len(self.work)


def _staged(configs: DataFrame, requests: DataFrame, last_id: int) -> DataFrame:
    """Checked requests with what is known up front: target row, first owner.

    A row can be deleted once and never comes back, so whether an id of the table
    is alive at a request needs no rounds.  ``fresh`` marks requests whose id can
    only come from the log.
    """
    fresh = (F.col("op") != "create") & (F.col("id") > last_id)
    requests = requests.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    by_id = requests.where(F.col("id").isNotNull() & (F.col("op") != "create") & ~F.col("fresh"))
    named = by_id.groupBy("id").agg(
        F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("_gone")
    )
    homes = configs.select(
        "id",
        F.col("symbol_pair").alias("home"),
        F.col("delta_percent").alias("home_delta"),
        F.col("updated_at").alias("home_at"),
    )
    owners = configs.select(F.col("symbol_pair"), F.col("id").alias("owner0"))
    # stored: the log then meets a plain table, and a hot id can be split at run time
    targets = stored(named.join(homes, "id"), "targets")
    targeted = by_id.join(targets, "id", "left")
    targeted = targeted.withColumn(
        "alive",
        F.col("home").isNotNull()
        & (F.col("_gone").isNull() | (F.col("seq") <= F.col("_gone"))),
    ).drop("_gone")
    rest = requests.where(F.col("id").isNull() | (F.col("op") == "create") | F.col("fresh"))
    staged = targeted.unionByName(
        rest.withColumn("alive", F.col("op") == "create"), allowMissingColumns=True
    )
    # deletes name no symbol: kept out of the join, where they would all meet
    named = F.col("symbol_pair").isNotNull() & (F.col("op") != "delete")
    return (
        staged.where(named)
        .join(owners, "symbol_pair", "left")
        .unionByName(staged.where(~named), allowMissingColumns=True)
    )


def _guess() -> Column:
    free = F.col("owner0").isNull()
    return (
        F.when(F.col("op") == "create", free)
        .when(F.col("op") == "update", free | (F.col("owner0") == F.col("id")))
        .otherwise(True)
    )


def _entity_before(live: DataFrame, cuts: Cuts | None, limit: int) -> DataFrame:
    """Add ``was``: the last create or update of the same row that succeeds before.

    ``tried`` is the last one whether it succeeds or not.
    """
    names = F.col("op") != "delete"
    done = F.when(F.col("ok") & names, F.struct("seq", "symbol_pair", "delta_percent", "at"))
    asked = F.when(names, F.struct("seq", "symbol_pair"))
    rows = timeline(live, "entity", "seq", cuts, limit).prior(was=done, tried=asked).rows()
    return rows.drop("was_own", "tried_own")


def _moves(before: DataFrame) -> DataFrame:
    """What requests ask of symbols: (symbol, entity, seq, take).

    Every create and update takes the symbol it names.  A delete, and an update that
    is guessed to succeed, leaves the symbol its row is guessed to have, and the one it
    tried last: to leave a symbol that one does not hold changes nothing, and with
    both the guess about the last attempt need not be right.
    """
    names, gone = F.col("op") != "delete", F.col("op") == "delete"
    left = F.array_distinct(
        F.array(F.coalesce("was.symbol_pair", "home"), F.coalesce("tried.symbol_pair", "home"))
    )
    left = F.filter(left, lambda s: s.isNotNull() & (gone | (s != F.col("symbol_pair"))))
    leaves = F.when(gone | ((F.col("op") == "update") & F.col("ok")), left)
    takes = before.where(names).select(
        F.col("symbol_pair").alias("symbol"), "entity", "seq", F.lit(True).alias("take")
    )
    leaves = before.select(
        F.explode(leaves).alias("symbol"), "entity", "seq", F.lit(False).alias("take")
    )
    return takes.unionByName(leaves)


def _asked(moves: DataFrame, cuts: Cuts) -> DataFrame:
    """Takes with ``next``: who gets the symbol if this one gets it, once its row leaves."""
    back = moves.withColumn("back", -F.col("seq"))
    exits = F.when(~F.col("take"), F.struct("back", "_following"))
    rows = (
        timeline(back, "symbol", "back", cuts)
        .prior(_following=F.when(F.col("take"), F.col("back")))
        .prior(within=("entity",), _exit=exits)
        .rows()
    )
    return rows.where("take").select(
        "symbol", "entity", "seq", (-F.col("_exit._following")).alias("next")
    )


def _holders(asked: DataFrame, save) -> tuple[DataFrame, int]:
    """The takes (symbol, seq) that find their symbol free, and the steps it took.

    They are what can be reached from the first take of each symbol along ``next``.
    """
    pointers = asked.where(F.col("next").isNotNull()).select("symbol", "seq", "next")
    reached = save(asked.groupBy("symbol").agg(F.min("seq").alias("seq")), "reached=0")
    steps = 0
    while True:
        far = pointers.withColumnRenamed("next", "to1")
        for hop in range(1, HOPS):
            step = pointers.select(
                "symbol", F.col("seq").alias(f"to{hop}"), F.col("next").alias(f"to{hop + 1}")
            )
            far = far.join(step, ["symbol", f"to{hop}"], "left")
        steps += 1
        far = save(far.select("symbol", "seq", *[f"to{h}" for h in range(1, HOPS + 1)]), f"far={steps}")
        passed = F.array_compact(F.array(*[F.col(f"to{h}") for h in range(1, HOPS)]))
        more = reached.join(far, ["symbol", "seq"]).select("symbol", F.explode(passed).alias("seq"))
        reached = save(reached.unionByName(more), f"reached={steps}")
        pointers = far.where(F.col(f"to{HOPS}").isNotNull()).select(
            "symbol", "seq", F.col(f"to{HOPS}").alias("next")
        )
        if pointers.isEmpty():
            return reached, steps


def _judged(asked: DataFrame, holders: DataFrame, cuts: Cuts) -> DataFrame:
    """(seq, outcome) per take: it finds its symbol free, or held by its own row.

    A take that does not find it free finds it with the last one that did: between
    that row's leaving and the next taking there is no other take.
    """
    marked = asked.join(holders.withColumn("free", F.lit(True)), ["symbol", "seq"], "left")
    holder = F.when(F.col("free"), F.struct("seq", "entity"))
    rows = timeline(marked, "symbol", "seq", cuts).prior(_holder=holder).rows()
    own = F.coalesce(F.col("_holder.entity") == F.col("entity"), F.lit(False))
    return rows.where(F.col("seq") > BEGIN).select(
        "seq", (F.col("free").isNotNull() | own).alias("outcome")
    )


def _resolved(live: DataFrame, last_id: int, by_id: Cuts) -> DataFrame:
    """Give requests with fresh ids the create that is guessed to have made their id."""
    creates = live.where((F.col("op") == "create") & F.col("ok")).select("seq")
    made = number_rows(creates).select(
        (F.col("position") + F.lit(last_id + 1)).alias("id"), F.col("seq").alias("_born")
    )
    fresh = live.where("fresh").join(stored(made, "made"), "id", "left")
    born = F.when(F.col("_born") < F.col("seq"), -F.col("_born") - 1)
    fresh = fresh.withColumns({"was_entity": F.col("entity"), "entity": born})
    gone = F.when((F.col("op") == "delete") & F.col("entity").isNotNull(), F.lit(1))
    fresh = timeline(fresh, "id", "seq", by_id).prior(_gone=gone).rows()
    fresh = fresh.withColumn("_lives", F.col("entity").isNotNull() & F.col("_gone").isNull())
    # a request that has just found its row is guessed anew, one that lost it fails
    guess = F.when(F.col("alive"), F.col("ok")).otherwise(_guess())
    fresh = fresh.withColumns(
        {
            "ok": F.col("_lives") & guess,
            "moved": F.col("moved")
            | ~F.col("entity").eqNullSafe(F.col("was_entity"))
            | (F.col("_lives") != F.col("alive")),
            "alive": F.col("_lives"),
        }
    )
    return live.where(~F.col("fresh")).unionByName(fresh.select(*live.columns))


def _reach(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols whose outcomes may change, and the rows that name one of them."""
    moved = live.where("moved")
    rows = moved.select(F.explode(F.array("entity", "was_entity")).alias("entity"))
    rows = rows.where(F.col("entity").isNotNull()).distinct()
    named = F.explode(F.array_compact(F.array("symbol_pair", "home"))).alias("symbol")
    symbols = live.join(rows, "entity", "left_semi").select(named)
    symbols = symbols.unionByName(moved.select(named)).distinct()
    owned = live.where(F.col("entity").isNotNull()).select("entity", named)
    return symbols, owned.join(symbols, "symbol", "left_semi").select("entity").distinct()


def apply_requests(
    configs: DataFrame,
    requests: DataFrame,
    at: Column,
    event_id: Column | None = None,
    first_outbox_id: int = 1,
    rename_tombstones: bool = False,
    limit: int = TASK_ROWS,
    first_slice: int = FIRST_SLICE,
) -> Applied:
    """Apply a request log to the config table.

    ``at`` is the time of a request as an expression over its columns.  An update
    that renames a row emits the new symbol only, so a consumer keeps the old
    one; ``rename_tombstones`` adds a delete event for it.  Each
    round is written to the shared scratch folder, so lost executors cost a
    re-read and not a replay of the earlier rounds.

    A request may name an id that an earlier request of the log creates.  Ids of
    the table are not negative.
    """
    spark = configs.sparkSession
    folder = scratch_path(spark, "requests")
    errors = field_errors()
    invalid = errors["symbolPair"].isNotNull() | errors["deltaPercent"].isNotNull()
    # saved, because each request is read many times below and is to be checked once
    checked = _saver(spark, folder)(
        requests.withColumn("at", at).withColumn("invalid", invalid), "checked"
    )
    last_id = configs.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
    borders = _borders(checked, last_id, first_slice)
    done: list[_Slice] = []
    for n, (low, high) in enumerate(zip([None, *borders], [*borders, None])):
        part = checked
        if low is not None:
            part = part.where(F.col("seq") >= low)
        if high is not None:
            part = part.where(F.col("seq") < high)
        save = _saver(spark, f"{folder}/slice={n}")
        done.append(_apply_slice(configs, part, last_id, event_id, limit, save))
        configs = done[-1].configs
        if high is not None:
            configs = save(configs, "configs")
            last_id += done[-1].decided.where((F.col("op") == "create") & F.col("ok")).count()

    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    accepted = union([d.decided for d in done]).where("ok")

    def outbox():
        rows = number_rows(_outbox(accepted, rename_tombstones))
        return rows.withColumn("id", F.col("position") + F.lit(first_outbox_id)).select(
            "id", "event_id", "aggregatetype", "aggregateid", "type", "payload"
        )

    results = union([_results(d.staged, d.decided) for d in done])
    work = tuple(n for d in done for n in d.work)
    return Applied(configs, results, work, sum(d.steps for d in done), outbox)


def _saver(spark, folder: str):
    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return saved


def _borders(requests: DataFrame, last_id: int, first_slice: int) -> list[int]:
    """First ``seq`` of every slice but the first; none for logs without ids of their own."""
    fresh = (F.col("op") != "create") & (F.col("id") > last_id) & ~F.col("invalid")
    if requests.where(fresh).isEmpty():
        return []
    rows, ends = requests.count(), [first_slice]
    if rows <= first_slice:
        return []
    # a rest shorter than what is done goes with the slice before it
    while ends[-1] * (GROWTH + 2) < rows:
        ends.append(ends[-1] * (GROWTH + 1))
    found = requests.agg(F.percentile_approx("seq", [n / rows for n in ends], 10_000)).first()[0]
    return sorted(set(found))


@dataclass(frozen=True)
class _Slice:
    configs: DataFrame
    staged: DataFrame
    #: Judged requests with the row they concern and the state it had before.
    decided: DataFrame
    work: tuple[int, ...]
    steps: int


def _apply_slice(
    configs: DataFrame,
    requests: DataFrame,
    last_id: int,
    event_id: Column | None,
    limit: int,
    saved: Callable[[DataFrame, str], DataFrame],
) -> _Slice:
    """Apply consecutive requests; ``last_id`` is the last id given to a row before them."""
    staged = saved(_staged(configs, requests, last_id), "staged")
    # a create makes a row of its own; table ids are not negative
    entity = F.when(F.col("op") == "create", -F.col("seq") - 1).when(
        ~F.col("fresh"), F.col("id")
    )
    live = staged.where(~F.col("invalid") & (F.col("alive") | F.col("fresh"))).withColumns(
        {
            "ok": _guess() & F.col("alive"),
            "moved": F.lit(True),
            "entity": entity,
            "was_entity": F.lit(None).cast("long"),
        }
    )
    grows = not live.where("fresh").isEmpty()
    by_id = hot_cuts(live.where("fresh"), "id", limit) if grows else Cuts("id")
    # rows made by the log differ per round: looked for anew if one of them is hot
    by_entity = hot_cuts(live, "entity", limit) if by_id.hot is None else None
    by_symbol = hot_cuts(live, "symbol_pair", limit)
    # who holds a symbol first counts as a take before all requests
    first = live.where(F.col("owner0").isNotNull()).select(
        F.col("symbol_pair").alias("symbol"),
        F.col("owner0").alias("entity"),
        F.lit(BEGIN).alias("seq"),
        F.lit(True).alias("take"),
    )
    first = saved(first.distinct(), "first")

    work: list[int] = []
    steps = 0
    while True:
        name = f"round={len(work)}"
        if grows:
            live = saved(_resolved(live, last_id, by_id), f"{name}/resolved")
        known = F.col("entity").isNotNull() & F.col("alive")
        active, symbols = live.where(known), None
        if work:
            if live.where("moved").isEmpty():
                break
            symbols, rows = _reach(live)
            symbols, rows = saved(symbols, f"{name}/symbols"), saved(rows, f"{name}/rows")
            active = active.join(rows, "entity", "left_semi")
        moves = _moves(_entity_before(active, by_entity, limit)).unionByName(first)
        if symbols is not None:
            moves = moves.join(symbols, "symbol", "left_semi")
        asked = saved(_asked(moves, by_symbol), f"{name}/asked")
        holders, more = _holders(asked, lambda df, part: saved(df, f"{name}/{part}"))
        steps += more
        judged = saved(_judged(asked, holders, by_symbol), f"{name}/judged")
        work.append(judged.count())
        settled = live.join(judged, "seq", "left")
        outcome = F.coalesce(F.col("outcome"), F.col("ok"))
        # a create changes no other symbol; what it means for ids shows in the ids
        flips = (outcome != F.col("ok")) & (F.col("op") == "update")
        live = saved(
            settled.withColumns({"moved": flips, "ok": outcome, "was_entity": F.lit(None).cast("long")})
            .drop("outcome"),
            f"{name}/live",
        )

    owned, lost = F.col("entity").isNotNull(), F.col("entity").isNull()
    final = _entity_before(live.where(owned), by_entity, limit).drop("tried")
    final = saved(final.unionByName(live.where(lost), allowMissingColumns=True), "final")
    created = number_rows(
        final.where((F.col("op") == "create") & F.col("ok"))
    ).withColumn("row_id", F.col("position") + F.lit(last_id + 1)).drop("position")
    others = final.where((F.col("op") != "create") | ~F.col("ok")).withColumn(
        "row_id", F.col("id")
    )
    named = F.expr("uuid()") if event_id is None else event_id
    # saved with their event ids: a random id must not change on a second read
    decided = saved(created.unionByName(others).withColumn("event_id", named), "decided")

    after = _new_table(configs, decided.where("ok"))
    return _Slice(after, staged, decided, tuple(work), steps)


def _results(staged: DataFrame, decided: DataFrame) -> DataFrame:
    status = F.lit(None).cast("int")
    for op, code in OK_STATUS.items():
        status = F.when(F.col("op") == op, code).otherwise(status)
    missing = F.col("fresh") & ~F.col("alive")
    done = decided.select(
        "seq",
        "op",
        F.col("row_id").alias("id"),
        F.when(F.col("ok"), status).when(missing, 404).otherwise(409).alias("status"),
        F.when(missing, "PRICE_CONFIG_NOT_FOUND")
        .when(~F.col("ok"), "DUPLICATE_SYMBOL_PAIR")
        .alias("error_code"),
    )
    refused = staged.where(F.col("invalid") | ~(F.col("alive") | F.col("fresh")))
    refused = refused.select(
        "seq",
        "op",
        "id",
        F.when(F.col("invalid"), 400).otherwise(404).alias("status"),
        F.when(F.col("invalid"), "VALIDATION_FAILED")
        .otherwise("PRICE_CONFIG_NOT_FOUND")
        .alias("error_code"),
    )
    return done.unionByName(refused)


def _row_after() -> dict[str, Column]:
    """Columns of the row a request leaves behind, or removes."""
    removed = F.col("op") == "delete"
    return {
        "symbol_pair": F.when(removed, F.coalesce("was.symbol_pair", "home")).otherwise(
            F.col("symbol_pair")
        ),
        "delta_percent": F.when(
            removed, F.coalesce("was.delta_percent", "home_delta")
        )
        .otherwise(F.col("delta_percent"))
        .cast(DELTA),
        "updated_at": F.when(removed, F.coalesce("was.at", "home_at")).otherwise(F.col("at")),
    }


def _outbox(accepted: DataFrame, rename_tombstones: bool) -> DataFrame:
    """An outbox row per accepted request; a delete carries the row it removed."""
    rows = accepted.withColumns(_row_after())
    kind = F.lit(None).cast("string")
    for op, name in EVENT.items():
        kind = F.when(F.col("op") == op, name).otherwise(kind)
    rows = rows.select(
        (F.col("seq") * 2 + 1).alias("seq"),
        "event_id",
        "row_id",
        kind.alias("type"),
        "symbol_pair",
        "delta_percent",
        "updated_at",
        F.coalesce("was.symbol_pair", "home").alias("_from"),
    )
    if rename_tombstones:
        old = rows.where(
            (F.col("type") == EVENT["update"]) & (F.col("_from") != F.col("symbol_pair"))
        ).withColumns(
            {
                "seq": F.col("seq") - 1,
                "event_id": F.concat("event_id", F.lit("-renamed")),
                "type": F.lit(EVENT["delete"]),
                "symbol_pair": F.col("_from"),
            }
        )
        rows = rows.unionByName(old)
    micros = F.date_format("updated_at", "SSSSSS")
    instant = F.concat(
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
        F.lit("Z"),
    )
    payload = F.to_json(
        F.struct(
            F.col("row_id").alias("id"),
            F.col("symbol_pair").alias("symbolPair"),
            F.col("delta_percent").alias("deltaPercent"),
            instant.alias("updatedAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select(
        "seq",
        "event_id",
        F.lit(AGGREGATE_TYPE).alias("aggregatetype"),
        F.col("row_id").cast("string").alias("aggregateid"),
        "type",
        payload.alias("payload"),
    )


def _new_table(configs: DataFrame, accepted: DataFrame) -> DataFrame:
    """The table after all requests: untouched rows, and touched ones not deleted."""
    after = _row_after()
    touched = accepted.select(
        F.col("row_id").alias("id"),
        "seq",
        after["symbol_pair"].alias("symbol_pair"),
        after["delta_percent"].alias("delta_percent"),
        after["updated_at"].alias("updated_at"),
        (F.col("op") == "delete").alias("_removed"),
    )
    last = latest_by(touched, ["id"], ["seq"])
    untouched = configs.join(last.select("id"), "id", "left_anti")
    kept = last.where(~F.col("_removed")).select(*configs.columns)
    return untouched.unionByName(kept)


__all__ = [
    "Applied",
    "apply_requests",
    "field_errors",
    "validation_errors",
]
