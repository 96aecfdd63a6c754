"""Display helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING = "—"
TIME_PATTERN = "M/d/yyyy, h:mm:ss a"


def format_price(value: Column) -> Column:
    """Thousands separators, and more decimals for smaller prices."""

    def shown(places: int) -> Column:
        return F.format_number(F.round(value, places), places)

    return (
        F.when(value.isNull(), MISSING)
        .when(value >= 1000, shown(2))
        .when(value >= 1, shown(4))
        .otherwise(shown(8))
    )


def format_delta(value: Column) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(
        F.concat(F.format_number(F.round(value, 2), 2), F.lit(" %"))
    )


def format_time(millis: Column) -> Column:
    """Date and time in the session time zone; null and 0 read as missing."""
    return F.when(
        F.coalesce(millis, F.lit(0)) != 0,
        F.date_format(F.timestamp_millis(millis), TIME_PATTERN),
    ).otherwise(MISSING)


def base_symbol(symbol: Column) -> Column:
    """The part before the first ``-`` or ``/``, at most four characters."""
    return F.substring(F.split(F.coalesce(symbol, F.lit("")), "[-/]").getItem(0), 1, 4)


def normalise_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 UTC, 0 for null."""
    return F.coalesce(F.unix_millis(ts.cast("timestamp")), F.lit(0).cast("long"))
