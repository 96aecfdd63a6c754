"""Per-event changelogs of streams, with the batch operators.

The update-mode aggregate in ``operators.joins.join_state`` gives one row per
touched symbol and batch.  Where every single event has to appear, each
micro-batch runs ``join_changelog`` or ``fold_changelog`` on its rows with the
kept state of the symbols it touches as seed, and stores the changes and the new
state under the batch id.  State is kept in buckets (``streaming.keyed``): a batch
reads and rewrites those of its symbols.  A repeated batch reads the state before
it and leaves the same rows, at any time.

Rows that arrive in a later batch than their ``seq`` belongs to: the join keeps
the newest of each side by its own ordering, so a late row emits the state in
force; the fold takes rows as they arrive, batch after batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.operators.fold import fold_changelog, fold_state
from bandstream.operators.joins import join_changelog
from bandstream.operators.latest import latest_by, merge_streams
from bandstream.operators.runs import TASK_ROWS, Cuts
from bandstream.schemas import DELTA, PRICE, TAGGED_LOG
from bandstream.sources.store import CompactedChangelog
from bandstream.streaming.keyed import KeyedState


def _state(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


_SIDE = T.StructType([f for f in TAGGED_LOG if f.name != "symbol_pair"])
JOIN_STATE = _state(("symbol_pair", T.StringType()), ("config", _SIDE), ("price", _SIDE))
FOLD_STATE = _state(
    ("symbol_pair", T.StringType()),
    ("config_id", T.LongType()),
    ("price", PRICE),
    ("delta_percent", DELTA),
    ("config_event_at", T.LongType()),
)


def _each_batch(changes: CompactedChangelog, state: KeyedState, step: Callable):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("symbol_pair").isNotNull()).persist()
        try:
            # a batch that one task can hold has no key to cut: no search for one
            cuts = Cuts("symbol_pair") if rows.count() <= TASK_ROWS else None
            kept = state.open(rows, batch_id)
            touched = rows.select("symbol_pair").distinct()
            held = kept.rows()
            emitted, after = step(rows, held.join(touched, "symbol_pair", "left_semi"), cuts)
            changes.append(emitted, batch_id)
            others = held.join(touched, "symbol_pair", "left_anti")
            kept.replace(others.unionByName(after))
        finally:
            rows.unpersist()

    return write


def _side_rows(state: DataFrame, side: str) -> DataFrame:
    held = state.where(F.col(side).isNotNull())
    return held.select("symbol_pair", f"{side}.*")


def join_step(
    rows: DataFrame, before: DataFrame, cuts: Cuts | None = None
) -> tuple[DataFrame, DataFrame]:
    """Changes of a batch, and the latest config and price of its symbols."""
    seed = merge_streams(_side_rows(before, "config"), _side_rows(before, "price"))
    emitted = join_changelog(rows, cuts, seed=seed)
    known = merge_streams(rows.select(*TAGGED_LOG.names), seed)
    last = {
        "config": (known.where("side = 'C'"), ["config_event_at", "seq"]),
        "price": (known.where("side = 'P'"), ["seq"]),
    }
    sides = [
        latest_by(part, ["symbol_pair"], order).select(
            "symbol_pair", F.struct(*_SIDE.names).alias(name)
        )
        for name, (part, order) in last.items()
    ]
    return emitted, sides[0].join(sides[1], "symbol_pair", "full")


def fold_step(
    rows: DataFrame, before: DataFrame, cuts: Cuts | None = None
) -> tuple[DataFrame, DataFrame]:
    """Changes of a batch, and the entries of its symbols; a dropped one is not kept."""
    emitted = fold_changelog(rows, seed=before, cuts=cuts)
    return emitted, fold_state(rows, seed=before).select(*FOLD_STATE.names)


def join_into(changes: CompactedChangelog, state: KeyedState):
    """A ``foreachBatch`` function: the join changelog of a tagged log."""
    return _each_batch(changes, state, join_step)


def fold_into(changes: CompactedChangelog, state: KeyedState):
    """A ``foreachBatch`` function: the fold changelog of a tagged log.

    To start from restored entries, give them to ``state.start_from`` first.
    """
    return _each_batch(changes, state, fold_step)
