"""Row shapes, one per logical table.  Readers use these and never infer."""

from pyspark.sql import types as T

PRICE = T.DecimalType(24, 8)
DELTA = T.DecimalType(9, 6)
# price (16 integer digits) plus or minus up to 999.999999 % of itself
BAND = T.DecimalType(28, 8)


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


HEADER = _fields(("key", T.StringType()), ("value", T.BinaryType()))

KAFKA_ROW = _fields(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
    ("timestamp", T.TimestampType()),
    ("key", T.StringType()),
    ("value", T.StringType()),
    ("headers", T.ArrayType(HEADER)),
)

PRICE_CONFIG = _fields(
    ("id", T.LongType()),
    ("symbol_pair", T.StringType()),
    ("delta_percent", DELTA),
    ("updated_at", T.TimestampType()),
)

OUTBOX = _fields(
    ("id", T.LongType()),
    ("event_id", T.StringType()),
    ("aggregatetype", T.StringType()),
    ("aggregateid", T.StringType()),
    ("type", T.StringType()),
    ("payload", T.StringType()),
)

CONFIG_EVENT = _fields(
    ("id", T.LongType()),
    ("symbol_pair", T.StringType()),
    ("delta_percent", DELTA),
    ("config_event_at", T.LongType()),
    ("deleted", T.BooleanType()),
    ("seq", T.LongType()),
)

MARKET_PRICE = _fields(
    ("symbol_pair", T.StringType()),
    ("price", PRICE),
    ("price_at", T.LongType()),
    ("deleted", T.BooleanType()),
    ("seq", T.LongType()),
)

# Config events (side 'C') and market prices (side 'P') on one time line.
TAGGED_LOG = _fields(
    ("symbol_pair", T.StringType()),
    ("seq", T.LongType()),
    ("side", T.StringType()),
    ("id", T.LongType()),
    ("delta_percent", DELTA),
    ("config_event_at", T.LongType()),
    ("price", PRICE),
    ("price_at", T.LongType()),
    ("deleted", T.BooleanType()),
)

FULL_CONFIG = _fields(
    ("symbol_pair", T.StringType()),
    ("config_id", T.LongType()),
    ("price", PRICE),
    ("delta_percent", DELTA),
    ("low_price", BAND),
    ("high_price", BAND),
    ("price_at", T.LongType()),
    ("config_event_at", T.LongType()),
)

CHANGELOG = T.StructType(
    FULL_CONFIG.fields
    + _fields(("op", T.StringType()), ("seq", T.LongType())).fields
)

FOLD_CHANGELOG = _fields(
    ("symbol_pair", T.StringType()),
    ("config_id", T.LongType()),
    ("price", PRICE),
    ("delta_percent", DELTA),
    ("low_price", BAND),
    ("high_price", BAND),
    ("config_event_at", T.LongType()),
    ("op", T.StringType()),
    ("seq", T.LongType()),
)

# JSON names of a joined row on the wire (fixed values, in order).
FULL_CONFIG_WIRE = {
    "symbol_pair": "symbolPair",
    "config_id": "configId",
    "price": "price",
    "delta_percent": "deltaPercent",
    "low_price": "lowPrice",
    "high_price": "highPrice",
    "price_at": "priceAt",
    "config_event_at": "configEventAt",
}

CONFIG_EVENT_WIRE = {
    "id": "id",
    "symbol_pair": "symbolPair",
    "delta_percent": "deltaPercent",
    "config_event_at": "configEventAt",
    "deleted": "deleted",
}

MARKET_PRICE_WIRE = {
    "symbol_pair": "symbolPair",
    "price": "price",
    "price_at": "priceAt",
}


def wire_type(table: T.StructType, names: dict[str, str]) -> T.StructType:
    """The JSON object type for ``table`` under its wire names."""
    return T.StructType(
        [T.StructField(names[f.name], f.dataType) for f in table if f.name in names]
    )
