"""Outbox change events: routing rows to messages, and reading messages back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandstream.functions.staging import compute_once
from bandstream.schemas import DELTA
from bandstream.sources.records import arrival

# Header names, event types and their meaning, ISO instants.
ID_HEADER = "id"
TYPE_HEADER = "eventType"
KEEPS = ("PriceConfigCreated", "PriceConfigUpdated")
DROPS = ("PriceConfigDeleted",)
INSTANT = (
    r"^[+-]?\d{4,10}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d(:\d\d){0,2})$"
)


def last_header(headers: Column, name: str) -> Column:
    """Text of the last header called ``name``, null when there is none."""
    matching = F.filter(headers, lambda h: h["key"] == name)
    return F.try_element_at(matching, F.lit(-1))["value"].cast("string")


def deleted_flag(event_type: Column) -> Column:
    """False for a create or update, true for a delete, null for anything else."""
    return F.when(event_type.isin(*KEEPS), False).when(event_type.isin(*DROPS), True)


def _parsed(raw: DataFrame) -> DataFrame:
    """Add the JSON document, or its ``payload`` member where it has one.

    A ``payload`` of JSON null counts as present, so such a record has no
    fields.
    """
    root = compute_once(
        raw,
        {
            "event_type": last_header(F.col("headers"), TYPE_HEADER),
            "_root": F.try_parse_json("value"),
        },
    )
    inner = F.try_variant_get(F.col("_root"), "$.payload", "variant")
    return compute_once(root, {"_body": F.coalesce(inner, "_root")}).drop("_root")


def _text(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "string")


def raw_fields(raw: DataFrame) -> DataFrame:
    """Each record with its event type and the texts of its four fields."""
    body = F.col("_body")
    texts = compute_once(
        _parsed(raw),
        {
            "_id": _text(body, "id"),
            "_symbol": _text(body, "symbolPair"),
            "_delta": _text(body, "deltaPercent"),
            "_at": _text(body, "updatedAt"),
            "_json": body.isNotNull(),
        },
    )
    return texts.drop("_body")


def _typed(rows: DataFrame) -> DataFrame:
    instant = F.when(F.col("_at").rlike(INSTANT), F.col("_at")).try_cast("timestamp")
    exact = F.when(F.col("_delta") == F.trim("_delta"), F.col("_delta"))
    return compute_once(
        rows,
        {
            "id": F.col("_id").try_cast("long"),
            "symbol_pair": F.col("_symbol"),
            "delta_percent": exact.try_cast(DELTA),
            "_millis": F.unix_millis(instant),
            "deleted": deleted_flag(F.col("event_type")),
        },
    ).withColumn("config_event_at", F.coalesce("_millis", F.lit(0).cast("long")))


def _lost(text: str, value: str) -> Column:
    return F.col(text).isNotNull() & F.col(value).isNull()


def classify(raw: DataFrame) -> DataFrame:
    """Every record, parsed, with the first ``reason`` it cannot be used, or null."""
    rows = _typed(raw_fields(raw))
    reason = (
        F.when(F.col("value").isNull(), "tombstone")
        .when(F.col("event_type").isNull(), "no event type")
        .when(F.col("deleted").isNull(), "unknown event type")
        .when(~F.col("_json"), "not json")
        .when(_lost("_id", "id"), "bad id")
        .when(_lost("_delta", "delta_percent"), "bad delta")
        .when(_lost("_at", "_millis"), "bad time")
        .when(F.col("symbol_pair").isNull(), "no symbol")
    )
    return rows.withColumns({"reason": reason, "seq": arrival()})


def accepted(classified: DataFrame) -> DataFrame:
    """The config events among classified records."""
    return classified.where(F.col("reason").isNull()).select(
        "id", "symbol_pair", "delta_percent", "config_event_at", "deleted", "seq"
    )


def rejected(classified: DataFrame) -> DataFrame:
    """The other ones, as they came, with the reason."""
    return classified.where(F.col("reason").isNotNull()).select(
        "topic", "partition", "offset", "key", "value", "reason"
    )


def parse_cdc(raw: DataFrame) -> DataFrame:
    """Outbox messages to config events; records that cannot be used are dropped."""
    return accepted(classify(raw))


def cdc_rejects(raw: DataFrame) -> DataFrame:
    """The records ``parse_cdc`` drops, with the reason."""
    return rejected(classify(raw))


def route_outbox(outbox: DataFrame) -> DataFrame:
    """Outbox rows to messages: topic by aggregate type, key by aggregate id."""

    def header(name: str, value: str) -> Column:
        return F.struct(
            F.lit(name).alias("key"), F.encode(F.col(value), "UTF-8").alias("value")
        )

    return outbox.select(
        F.concat("aggregatetype", F.lit(".events")).alias("topic"),
        F.col("aggregateid").alias("key"),
        F.col("payload").alias("value"),
        F.array(header(ID_HEADER, "event_id"), header(TYPE_HEADER, "type")).alias("headers"),
        F.col("id").alias("offset"),
    )


def outbox_after(outbox: DataFrame, high_water: int) -> DataFrame:
    """Rows added since ``high_water``; the table only ever grows."""
    return outbox.where(F.col("id") > high_water)
