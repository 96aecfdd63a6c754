"""Views that read the supplied tables as config logs, ticks, outbox, requests.

Narrow projections of one table each: no joins and no shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.functions.text import epoch_millis
from bandstream.schemas import DELTA, PRICE

DAY_MS = 86_400_000
# Event names and aggregate type of the outbox.
CREATED, UPDATED, DELETED = (
    "PriceConfigCreated",
    "PriceConfigUpdated",
    "PriceConfigDeleted",
)
AGGREGATE_TYPE = "PRICE_CONFIG"

EVENT_TYPES = {"signup": CREATED, "click": UPDATED, "error": DELETED}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn(
        "symbol_pair", F.concat(F.lit("S"), F.col("user_id"))
    )


def _type() -> Column:
    out = F.lit(None).cast("string")
    for name, kind in EVENT_TYPES.items():
        out = F.when(F.col("event_type") == name, kind).otherwise(out)
    return out


def log_view(events: DataFrame) -> DataFrame:
    """One tagged log of config events and ticks; late and tied revisions occur."""
    base = _events(events)
    config = F.col("event_type").isin(*EVENT_TYPES)
    day = epoch_millis(F.date_trunc("day", "ts"))
    return base.select(
        "symbol_pair",
        F.col("event_id").alias("seq"),
        F.when(config, "C").otherwise("P").alias("side"),
        F.when(config, F.col("user_id")).alias("id"),
        F.when(config, F.col("k") * F.lit(0.125)).cast(DELTA).alias("delta_percent"),
        F.when(config, day - F.pmod("k", F.lit(3)) * F.lit(DAY_MS)).alias("config_event_at"),
        F.when(~config, F.col("value").cast(PRICE)).alias("price"),
        F.when(~config, epoch_millis(F.col("ts"))).alias("price_at"),
        (F.col("event_type") == "error").alias("deleted"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(read(spark, sf_dir, "events"))


def log_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        log(spark, sf_dir)
        .where(F.col("side") == "C")
        .select("id", "symbol_pair", "delta_percent", "config_event_at", "deleted", "seq")
    )


def log_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        log(spark, sf_dir)
        .where(F.col("side") == "P")
        .select("symbol_pair", "price", "price_at", "seq")
    )


def _iso(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cdc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config events as outbox messages, some of them damaged by rule of k."""
    base = _events(read(spark, sf_dir, "events")).where(
        F.col("event_type").isin(*EVENT_TYPES)
    )
    k = F.col("k")

    def hit(n: int) -> Column:
        return F.pmod(k, F.lit(n)) == 0

    at = epoch_millis(F.date_trunc("day", "ts")) - F.pmod("k", F.lit(3)) * F.lit(DAY_MS)
    body = F.to_json(
        F.struct(
            F.col("user_id").alias("id"),
            F.when(~hit(29) | hit(31), F.col("symbol_pair")).alias("symbolPair"),
            (k * F.lit(0.125)).cast(DELTA).alias("deltaPercent"),
            _iso(at).alias("updatedAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    header_type = F.when(hit(23), F.lit("PriceConfigRenamed")).otherwise(_type())

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

    ident = header("id", F.concat(F.lit("e-"), F.col("event_id")))
    one = F.array(ident, header("eventType", header_type))
    none = F.array(ident)
    double = F.array(
        ident, header("eventType", F.lit("PriceConfigRenamed")), header("eventType", _type())
    )
    early = hit(31) | hit(29) | hit(23)
    return base.select(
        F.lit(f"{AGGREGATE_TYPE}.events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").cast("string").alias("key"),
        F.when(hit(31), F.lit(None).cast("string"))
        .when(hit(29) | hit(23) | hit(19), body)
        .when(hit(17), F.lit("not-json"))
        .when(hit(13), F.concat(F.lit('{"payload":'), body, F.lit("}")))
        .otherwise(body)
        .alias("value"),
        F.when(early, one)
        .when(hit(19), none)
        .when(hit(17) | hit(13), one)
        .when(hit(11), double)
        .otherwise(one)
        .alias("headers"),
    )


def config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price config table, from ``customer``."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("S"), F.col("c_custkey")).alias("symbol_pair"),
        (F.abs("c_acctbal").cast("decimal(9,2)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast(DELTA)
        .alias("delta_percent"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("updated_at"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey")).alias("symbol_pair"),
        F.col("o_totalprice").cast(PRICE).alias("price"),
        epoch_millis(F.col("o_orderdate")).alias("price_at"),
        F.col("o_orderkey").alias("seq"),
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of every part.

    ``seq`` packs (ship day, order, line) into one long: same order as sorting
    by these columns, unique per part, and no window needed.  45 bits of order
    key and 14 of day leave the sign alone.
    """
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    packed = (day * F.lit(1 << 45) + F.col("l_orderkey")) * 8 + F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("symbol_pair"),
        F.col("l_extendedprice").cast(PRICE).alias("price"),
        epoch_millis(F.col("l_shipdate")).alias("price_at"),
        packed.alias("seq"),
    )


def part_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("symbol_pair"),
        F.col("p_size").cast(DELTA).alias("delta_percent"),
        F.lit(0).cast("long").alias("config_event_at"),
        F.lit(False).alias("deleted"),
        F.lit(-1).cast("long").alias("seq"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _events(read(spark, sf_dir, "events")).where(
        F.col("event_type").isin(*EVENT_TYPES)
    )
    at = epoch_millis(F.date_trunc("day", "ts")) - F.pmod("k", F.lit(3)) * F.lit(DAY_MS)
    return base.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("e-"), F.col("event_id")).alias("event_id"),
        F.lit(AGGREGATE_TYPE).alias("aggregatetype"),
        F.col("user_id").cast("string").alias("aggregateid"),
        _type().alias("type"),
        F.to_json(
            F.struct(
                F.col("user_id").alias("id"),
                F.col("symbol_pair").alias("symbolPair"),
                (F.col("k") * F.lit(0.125)).cast(DELTA).alias("deltaPercent"),
                _iso(at).alias("updatedAt"),
            )
        ).alias("payload"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutation requests: creates, updates (some rename), deletes, invalid creates."""
    base = _events(read(spark, sf_dir, "events"))
    kind = F.col("event_type")
    k = F.col("k")
    rule = F.pmod(k, F.lit(4))
    bad = kind == "purchase"
    delta = (k * F.lit(0.125)).cast("decimal(38,18)")
    bad_delta = (
        F.when(rule == 0, -delta - 1)
        .when(rule == 1, delta + F.lit("1000").cast("decimal(38,18)"))
        .when(rule == 2, F.lit(None).cast("decimal(38,18)"))
        .otherwise(delta + F.lit("0.0000001").cast("decimal(38,18)"))
    )
    renamed = F.concat(F.lit("R"), F.col("user_id") + F.pmod(k, F.lit(5)))
    return base.select(
        F.col("event_id").alias("seq"),
        F.when(kind.isin("signup", "purchase"), "create")
        .when(kind == "error", "delete")
        .otherwise("update")
        .alias("op"),
        F.when(kind.isin("click", "view", "error"), F.col("user_id")).alias("id"),
        F.when(bad & (rule == 2), F.rpad("symbol_pair", 40, "X"))
        .when((kind == "view") & (F.pmod(k, F.lit(2)) == 0), renamed)
        .when(kind != "error", F.col("symbol_pair"))
        .alias("symbol_pair"),
        F.when(bad, bad_delta).when(kind != "error", delta).cast("decimal(38,18)").alias("delta_percent"),
    )


def fresh_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutation requests that also name ids which earlier ones of them create.

    Creates take symbols of their own, and a third of the updates and deletes name
    an id above those of the table, which may not be there yet, or not any more.
    """
    last = config_table(spark, sf_dir).agg(F.max("id")).first()[0]
    own = F.concat(F.lit("N"), F.pmod("seq", F.lit(last)))
    named = F.pmod("seq", F.lit(3)) == 0
    later = F.lit(last + 1) + F.floor(F.col("seq") / 16)
    return requests(spark, sf_dir).select(
        "seq",
        "op",
        F.when((F.col("op") != "create") & named, later).otherwise(F.col("id")).alias("id"),
        F.when((F.col("op") != "delete") & (F.length("symbol_pair") <= 32) & (F.pmod("seq", F.lit(2)) == 0), own)
        .otherwise(F.col("symbol_pair"))
        .alias("symbol_pair"),
        "delta_percent",
    )
