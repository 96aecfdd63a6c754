"""Push payloads: changed rows as JSON arrays, one per batch."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandstream.operators.runs import number_rows
from bandstream.sources.records import POLL_RECORDS, full_config_json

log = logging.getLogger(__name__)

# Channels, the size of a fold push, JSON names of a fold row.
CHANNEL = "price-stream"
STREAM_CHANNEL = "full-config-stream"
FOLD_PUSH = 100
FOLD_WIRE = {
    "presented": "presented",
    "deleted": "deleted",
    "config_id": "id",
    "symbol_pair": "symbolPair",
    "price": "price",
    "delta_percent": "deltaPercent",
    "low_price": "lowPrice",
    "high_price": "highPrice",
    "config_event_at": "configEventAt",
}


def poll_batches(changelog: DataFrame, size: int = POLL_RECORDS) -> DataFrame:
    """Cut a changelog into the batches a listener would see."""
    rows = number_rows(changelog)
    return rows.withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def _deletion_json() -> Column:
    return F.to_json(F.struct(F.col("symbol_pair").alias("symbolPair"), F.lit(True).alias("deleted")))


def _arrays(items: DataFrame, channel: str) -> DataFrame:
    """One JSON array per batch; a batch is bounded, so its list is too."""
    ordered = F.sort_array(F.collect_list(F.struct("_group", "_first", "_json")))
    texts = F.transform(ordered, lambda item: item["_json"])
    return items.groupBy("batch").agg(
        F.lit(channel).alias("channel"),
        F.count_if(F.col("_group") == 0).alias("upserts"),
        F.count_if(F.col("_group") == 1).alias("deletions"),
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("payload"),
    )


def push_payload(batches: DataFrame, channel: str = STREAM_CHANNEL) -> DataFrame:
    """Per batch: the last state of each changed symbol, upserts before deletions.

    ``batches`` is a changelog with a ``batch`` column.  Inside a group, symbols
    keep the order in which they took the state they end the batch with.
    """
    keyed = batches.where(F.col("symbol_pair").isNotNull())
    per_key = Window.partitionBy("batch", "symbol_pair")
    staged = keyed.withColumns(
        {
            "_last_u": F.max(F.when(F.col("op") == "U", F.col("seq"))).over(per_key),
            "_last_d": F.max(F.when(F.col("op") == "D", F.col("seq"))).over(per_key),
            "_json": F.when(F.col("op") == "D", _deletion_json()).otherwise(full_config_json()),
        }
    )
    # the state a symbol ends with began after the last record of the other kind
    other = F.when(
        F.col("_last_u").isNotNull() & F.col("_last_d").isNotNull(),
        F.least("_last_u", "_last_d"),
    )
    final_run = staged.where(other.isNull() | (F.col("seq") > other))
    items = final_run.groupBy("batch", "symbol_pair").agg(
        F.min("seq").alias("_first"),
        F.max(F.struct("seq", "op", "_json")).alias("_last"),
    )
    items = items.select(
        "batch",
        F.when(F.col("_last.op") == "D", 1).otherwise(0).alias("_group"),
        "_first",
        F.col("_last._json").alias("_json"),
    )
    return _arrays(items, channel)


def push_payload_fold(
    changelog: DataFrame, channel: str = CHANNEL, size: int = FOLD_PUSH
) -> DataFrame:
    """Fold pushes: every changed row in order, no deletions, ``size`` at a time."""
    changed = changelog.where((F.col("op") == "U") & F.col("symbol_pair").isNotNull())
    rows = number_rows(changed).withColumns(
        {"presented": F.lit(True), "deleted": F.lit(False)}
    )
    body = F.struct(*[F.col(c).alias(n) for c, n in FOLD_WIRE.items()])
    items = rows.select(
        F.floor(F.col("position") / size).cast("long").alias("batch"),
        F.lit(0).alias("_group"),
        F.col("seq").alias("_first"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("_json"),
    )
    return _arrays(items, channel).drop("deletions")


def push_envelope(payloads: DataFrame) -> DataFrame:
    """The request a push server takes: REST text, and the bytes of an RPC call."""
    channel = F.to_json(F.struct("channel"))
    # '{"channel":"c"}' without its closing brace, then the raw array
    params = F.concat(
        F.expr("substr(_channel, 1, length(_channel) - 1)"),
        F.lit(',"data":'),
        "payload",
        F.lit("}"),
    )
    return payloads.withColumn("_channel", channel).select(
        "batch",
        "channel",
        F.concat(F.lit('{"method":"publish","params":'), params, F.lit("}")).alias("request"),
        F.encode("payload", "UTF-8").alias("data"),
    )


def push(payloads: DataFrame, transport: Callable[[str, str], None]) -> None:
    """Call ``transport(channel, payload)`` per payload, on the executors.

    A failed push is logged and dropped: it must not hold up the sink.
    """

    def send(rows):
        for row in rows:
            try:
                transport(row["channel"], row["payload"])
            except Exception:
                log.exception("push to %s failed", row["channel"])

    payloads.select("channel", "payload").foreachPartition(send)
