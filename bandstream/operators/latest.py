"""Keyed tables: the last record per key, merging streams, batch collapse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fixed_width(kind: T.DataType) -> bool:
    return isinstance(
        kind,
        (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType),
    )


def latest_by(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order_cols``.

    With one numeric ordering column and fixed-width payload the per-column
    ``max_by`` keeps its buffers in place and plans as a hash aggregate.
    Anything else is the maximum of one struct, which Spark aggregates after a
    sort.  Both combine on the map side, so a hot key costs one row per task.
    """
    payload = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema}
    if len(order_cols) == 1 and all(_fixed_width(types[c]) for c in payload):
        order = order_cols[0]
        aggs = [
            F.max(c).alias(c) if c == order else F.max_by(c, order).alias(c)
            for c in payload
        ]
        return df.groupBy(*keys).agg(*aggs).select(*df.columns)
    rest = [c for c in payload if c not in order_cols]
    best = F.max(F.struct(*order_cols, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def latest_config(events: DataFrame) -> DataFrame:
    """Newest revision per symbol; of equal revisions the one that came last.

    Deleted revisions stay: they still outrank older ones.
    """
    return latest_by(
        events.where(F.col("symbol_pair").isNotNull()),
        ["symbol_pair"],
        ["config_event_at", "seq"],
    )


def active_configs(configs: DataFrame) -> DataFrame:
    return configs.where(~F.col("deleted"))


def latest_price(prices: DataFrame) -> DataFrame:
    """Last tick per symbol by arrival, whatever its own time; tombstones drop out."""
    last = latest_by(
        prices.where(F.col("symbol_pair").isNotNull()), ["symbol_pair"], ["seq"]
    )
    if "deleted" in prices.columns:
        last = last.where(~F.coalesce("deleted", F.lit(False)))
    return last


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Bag union by column name; a column one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def tag_log(configs: DataFrame, prices: DataFrame) -> DataFrame:
    """Config events and ticks as one log, told apart by ``side``."""
    return merge_streams(
        configs.withColumn("side", F.lit("C")), prices.withColumn("side", F.lit("P"))
    )


def tag_topics(configs: DataFrame, prices: DataFrame) -> DataFrame:
    """``tag_log`` for two topics whose ``seq`` are their own arrival numbers.

    Records of two topics can share offset and partition; the side becomes the
    lowest bit, so ``seq`` stays unique and configs come first among equals.
    """
    twice = F.shiftleft("seq", 1)
    return tag_log(
        configs.withColumn("seq", twice), prices.withColumn("seq", twice + F.lit(1).cast("long"))
    )


def rekey(events: DataFrame, key: Column) -> DataFrame:
    """Replace the record key.  A projection only: the next keyed step shuffles."""
    return events.withColumn("key", key)


def collapse(changelog: DataFrame, batch_col: str | None = None) -> DataFrame:
    """Keep the last record per key (and batch): ``op`` U is an upsert, D a delete."""
    keys = ["symbol_pair"] if batch_col is None else [batch_col, "symbol_pair"]
    return latest_by(changelog.where(F.col("symbol_pair").isNotNull()), keys, ["seq"])


def live_rows(changelog: DataFrame) -> DataFrame:
    """The table a changelog describes: last record per key, deletes dropped."""
    return collapse(changelog).where(F.col("op") == "U").drop("op")
