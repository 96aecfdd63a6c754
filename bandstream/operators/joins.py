"""Joining two changing tables: current state, and the changelog of the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandstream.functions.numeric import add_band
from bandstream.operators.latest import (
    active_configs,
    latest_config,
    latest_price,
    merge_streams,
)
from bandstream.operators.runs import TASK_ROWS, Cuts, timeline
from bandstream.schemas import CHANGELOG, FULL_CONFIG


Side = Callable[[str], Column]


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    joiner: Callable[[Side, Side], list[Column]],
) -> DataFrame:
    """Inner equi-join of two keyed tables.

    ``joiner`` gets one column lookup per side and returns the output columns,
    so both sides may come from the same table.
    """
    pick_left: Side = lambda name: F.col(f"_left.{name}")
    pick_right: Side = lambda name: F.col(f"_right.{name}")
    condition = reduce(
        lambda a, b: a & b, [pick_left(c) == pick_right(c) for c in on]
    )
    joined = left.alias("_left").join(right.alias("_right"), condition, "inner")
    return joined.select(*joiner(pick_left, pick_right))


def _full_config_columns(config: Side, price: Side) -> list[Column]:
    return [
        config("symbol_pair"),
        config("id").alias("config_id"),
        price("price"),
        config("delta_percent"),
        price("price_at"),
        config("config_event_at"),
    ]


def full_config(configs: DataFrame, prices: DataFrame) -> DataFrame:
    """Current join of the active configs with the last prices, with the band.

    Each side is reduced to one row per symbol before it is shuffled, and both
    aggregates leave their rows hashed by symbol, so the join adds no exchange.
    """
    joined = join_tables(
        active_configs(latest_config(configs)),
        latest_price(prices),
        ["symbol_pair"],
        _full_config_columns,
    )
    return add_band(joined).select(*FULL_CONFIG.names)


def config_entry() -> Column:
    """Config side of a tagged log row, ordered by revision, then arrival."""
    return F.when(
        F.col("side") == "C",
        F.struct(
            "config_event_at",
            "seq",
            F.col("id").alias("config_id"),
            "delta_percent",
            F.coalesce("deleted", F.lit(False)).alias("deleted"),
        ),
    )


def price_entry() -> Column:
    """Price side of a tagged log row, ordered by arrival."""
    return F.when(
        F.col("side") == "P",
        F.struct(
            "seq",
            "price",
            "price_at",
            F.coalesce("deleted", F.lit(False)).alias("deleted"),
        ),
    )


def _present(entry: str) -> Column:
    return F.coalesce(~F.col(f"{entry}.deleted"), F.lit(False))


def joined_columns(config: str, price: str) -> dict[str, Column]:
    return {
        "config_id": F.col(f"{config}.config_id"),
        "price": F.col(f"{price}.price"),
        "delta_percent": F.col(f"{config}.delta_percent"),
        "price_at": F.col(f"{price}.price_at"),
        "config_event_at": F.col(f"{config}.config_event_at"),
    }


def join_state(log: DataFrame) -> DataFrame:
    """Both latest entries per symbol in one aggregate over the tagged log.

    One shuffle serves both sides, and the same aggregate runs as a streaming
    query in update mode.  A symbol that has a side missing or deleted comes
    out as ``op`` D.
    """
    state = (
        log.where(F.col("symbol_pair").isNotNull())
        .groupBy("symbol_pair")
        .agg(
            F.max(config_entry()).alias("_config"),
            F.max(price_entry()).alias("_price"),
            F.max("seq").alias("seq"),
        )
    )
    return _as_changelog(state, F.when(_present("_config") & _present("_price"), "U").otherwise("D"))


def _as_changelog(state: DataFrame, op: Column) -> DataFrame:
    """Fill the joined columns where ``op`` is U, leave them null where it is D."""
    staged = state.withColumn("op", op).where(F.col("op").isNotNull())
    columns = {
        name: F.when(F.col("op") == "U", value)
        for name, value in joined_columns("_config", "_price").items()
    }
    return add_band(staged.withColumns(columns)).select(*CHANGELOG.names)


def join_changelog(
    log: DataFrame,
    cuts: Cuts | None = None,
    limit: int = TASK_ROWS,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Every change of the joined table: one row per update of either side.

    A row that leaves the symbol joined emits U, also when nothing changed.
    A row that takes it out of the join emits D.  Other rows emit nothing.

    ``seed`` has log rows that were handled before: they come first and emit
    nothing.  A log row older than a seed row of its side does not replace it.
    """
    rows, order = log.where(F.col("symbol_pair").isNotNull()), "seq"
    if seed is not None:
        rows = merge_streams(
            rows.withColumn("_new", F.lit(True)), seed.withColumn("_new", F.lit(False))
        ).withColumn("_order", F.struct("_new", "seq"))
        order = "_order"
    line = timeline(rows, seq=order, cuts=cuts, limit=limit)
    line = line.prior(_config0=config_entry(), _price0=price_entry())
    done = line.rows() if seed is None else line.rows().where("_new")
    state = done.select(
        "symbol_pair",
        "seq",
        "_config0",
        "_price0",
        F.greatest("_config0", "_config0_own").alias("_config"),
        F.greatest("_price0", "_price0_own").alias("_price"),
    )
    now = _present("_config") & _present("_price")
    was = _present("_config0") & _present("_price0")
    return _as_changelog(state, F.when(now, "U").when(was, "D"))


def enrich(
    stream: DataFrame, table: DataFrame, on: str = "symbol_pair", how: str = "left"
) -> DataFrame:
    """Look rows of ``stream`` (batch or streaming) up in the joined table.

    No broadcast hint: Spark replicates the table when its measured size is
    below the broadcast threshold and shuffles by ``on`` otherwise.
    """
    return stream.join(table, on, how)
