"""Message records: scans of topics, and the JSON forms rows take on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandstream.schemas import (
    CHANGELOG,
    CONFIG_EVENT,
    CONFIG_EVENT_WIRE,
    FULL_CONFIG,
    FULL_CONFIG_WIRE,
    KAFKA_ROW,
    MARKET_PRICE,
    MARKET_PRICE_WIRE,
    wire_type,
)

# Topic names and the records a listener takes per poll.
SNAPSHOT_TOPIC = "stream.PRICE_CONFIG.snapshot"
PRICE_TOPIC = "stream.MARKET_PRICE.events"
FULL_CONFIG_TOPIC = "stream.full-config.events"
POLL_RECORDS = 500

_CORRUPT = "_corrupt_record"


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_records: int | None = None
) -> DataFrame:
    """A topic as a stream of ``KAFKA_ROW``, from the earliest offset on.

    ``max_records`` bounds a micro-batch, for a backlog to be read in steps.
    """
    bound = {"maxOffsetsPerTrigger": str(max_records)} if max_records else {}
    reader = spark.readStream.format("kafka").options(
        **{
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "includeHeaders": "true",
            "startingOffsets": "earliest",
            **bound,
        }
    )
    return from_kafka(reader.load())


def kafka_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All records of a topic so far."""
    reader = spark.read.format("kafka").options(
        **{
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "includeHeaders": "true",
            "startingOffsets": "earliest",
        }
    )
    return from_kafka(reader.load())


def kafka_write(records: DataFrame, servers: str) -> None:
    """Write records (topic, key, value, and headers if there are) to their topics."""
    records.select(*_sink_columns(records)).write.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "includeHeaders": "true"}
    ).save()


def _sink_columns(records: DataFrame) -> list[str]:
    return [c for c in ("topic", "key", "value", "headers") if c in records.columns]


def from_kafka(df: DataFrame) -> DataFrame:
    text = {"key": F.col("key").cast("string"), "value": F.col("value").cast("string")}
    return df.withColumns(text).select(*KAFKA_ROW.names)


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = KAFKA_ROW,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Parquet files that keep arriving in ``path``; files already there come first.

    ``max_files`` or ``max_bytes`` bounds a micro-batch.
    """
    bound = {"maxFilesPerTrigger": max_files} if max_files else {}
    bound |= {"maxBytesPerTrigger": max_bytes} if max_bytes else {}
    return spark.readStream.schema(schema).options(**bound).parquet(path)


def arrival() -> Column:
    """Order of records: exact inside a partition, interleaved across them."""
    return F.shiftleft(F.col("offset"), 16) + F.col("partition")


def _sequenced(records: DataFrame) -> DataFrame:
    """Records with ``seq``; Kafka-shaped ones get it from offset and partition."""
    return records if "seq" in records.columns else records.withColumn("seq", arrival())


def _json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def _wire(names: dict[str, str], columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(names[c]) for c in names if c in columns])


def to_records(df: DataFrame, topic: str, names: dict[str, str]) -> DataFrame:
    """Rows as records keyed by symbol; ``op`` D becomes a record without value."""
    body = _json(_wire(names, df.columns))
    if "op" in df.columns:
        body = F.when(F.col("op") != "D", body)
    columns = [
        F.lit(topic).alias("topic"),
        F.col("symbol_pair").alias("key"),
        body.alias("value"),
    ]
    if "seq" in df.columns:
        columns.append("seq")
    return df.select(*columns)


def changelog_records(changelog: DataFrame) -> DataFrame:
    return to_records(changelog, FULL_CONFIG_TOPIC, FULL_CONFIG_WIRE)


def full_config_json() -> Column:
    return _json(_wire(FULL_CONFIG_WIRE, FULL_CONFIG.names))


def _parsed(records: DataFrame, table: T.StructType, names: dict[str, str]) -> DataFrame:
    shape = wire_type(table, names).add(_CORRUPT, T.StringType())
    return _sequenced(records).withColumn(
        "_row", F.from_json("value", shape, {"columnNameOfCorruptRecord": _CORRUPT})
    )


def _fields(table: T.StructType, names: dict[str, str]) -> list[Column]:
    return [F.col(f"_row.{names[f.name]}").alias(f.name) for f in table if f.name in names]


def _readable() -> Column:
    return F.col(f"_row.{_CORRUPT}").isNull()


def snapshot_scan(records: DataFrame) -> DataFrame:
    """Config events of the snapshot topic; unreadable records are left out."""
    rows = _parsed(records, CONFIG_EVENT, CONFIG_EVENT_WIRE)
    return rows.where(F.col("value").isNotNull() & _readable()).select(
        *_fields(CONFIG_EVENT, CONFIG_EVENT_WIRE), "seq"
    )


def price_scan(records: DataFrame) -> DataFrame:
    """The price topic as a table's changelog: a record without value is a delete."""
    rows = _parsed(records, MARKET_PRICE, MARKET_PRICE_WIRE)
    return rows.where(F.col("key").isNotNull() & _readable()).select(
        F.col("key").alias("symbol_pair"),
        F.col("_row.price").alias("price"),
        F.col("_row.priceAt").alias("price_at"),
        F.col("value").isNull().alias("deleted"),
        "seq",
    )


def changelog_scan(records: DataFrame) -> DataFrame:
    """Read the result topic back.

    A record without key is skipped, one without value is a delete, and an
    unreadable one is skipped, which leaves earlier records of its key in force.
    """
    rows = _parsed(records, FULL_CONFIG, FULL_CONFIG_WIRE)
    columns = {c.name: F.col(f"_row.{FULL_CONFIG_WIRE[c.name]}") for c in FULL_CONFIG}
    columns["symbol_pair"] = F.col("key")
    columns["op"] = F.when(F.col("value").isNull(), "D").otherwise("U")
    kept = rows.where(F.col("key").isNotNull() & _readable())
    return kept.select(
        *[columns[n].alias(n) for n in CHANGELOG.names if n != "seq"], "seq"
    )


def bad_records(records: DataFrame, table: T.StructType, names: dict[str, str]) -> DataFrame:
    """The quarantine side of the scans: records whose value cannot be read."""
    rows = _parsed(records, table, names)
    return rows.where(F.col("value").isNotNull() & ~_readable()).drop("_row")


def publish_prices(ticks: DataFrame, at: Column) -> DataFrame:
    """Ticks as price records stamped ``at``; a tick without symbol is skipped."""
    stamped = ticks.where(F.col("symbol_pair").isNotNull()).withColumn("price_at", at)
    return to_records(stamped, PRICE_TOPIC, MARKET_PRICE_WIRE)


def publish_snapshot(events: DataFrame) -> DataFrame:
    return to_records(events, SNAPSHOT_TOPIC, CONFIG_EVENT_WIRE)
