"""Decimal arithmetic: scaling, the price band, null-safe comparison."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandstream.schemas import BAND, DELTA, PRICE

# 16 significant digits, and the scale price * delta / 100 has.
SIGNIFICANT_DIGITS = 16
AMOUNT_SCALE = 16
# price has at most 16 integer digits and delta/100 at most 1.
MAX_INTEGER_DIGITS = 17
AMOUNT = f"decimal(34,{AMOUNT_SCALE})"


def as_price(value: Column) -> Column:
    """HALF_UP to 8 decimals; null when it has more than 16 integer digits."""
    return value.try_cast(PRICE)


def as_delta(value: Column) -> Column:
    """HALF_UP to 6 decimals; null when it has more than 3 integer digits."""
    return value.try_cast(DELTA)


def same_value(left: Column, right: Column) -> Column:
    """Numeric equality where two nulls are equal."""
    return left.eqNullSafe(right)


def raw_amount(price: Column, delta: Column) -> Column:
    """``price * delta / 100``, exact: decimal(37,16)."""
    return as_price(price) * as_delta(delta) * F.lit(Decimal("0.01"))


def decimal64(amount: Column) -> Column:
    """Round to 16 significant digits, ties to even.

    With ``k`` integer digits there are ``16 - k`` decimals left to keep, so
    the right rounding scale is picked by magnitude.
    """
    size = F.abs(amount)
    rounded = F.when(size < 1, amount.cast(AMOUNT))
    for k in range(1, MAX_INTEGER_DIGITS):
        rounded = rounded.when(
            size < F.lit(Decimal(10**k)),
            F.bround(amount, SIGNIFICANT_DIGITS - k).cast(AMOUNT),
        )
    return rounded.otherwise(
        F.bround(amount, SIGNIFICANT_DIGITS - MAX_INTEGER_DIGITS).cast(AMOUNT)
    )


def _edges(price: Column, amount: Column) -> tuple[Column, Column]:
    exact = as_price(price)
    return (
        F.round(exact - amount, 8).cast(BAND),
        F.round(exact + amount, 8).cast(BAND),
    )


def band(price: Column, delta: Column) -> tuple[Column, Column]:
    """``(low, high)`` around ``price``; null when either input is null."""
    return _edges(price, decimal64(raw_amount(price, delta)))


def add_band(df: DataFrame, price: str = "price", delta: str = "delta_percent") -> DataFrame:
    """Append ``low_price`` and ``high_price``.

    The amount is its own projection: it is used some twenty times by the
    rounding, and Spark keeps a costly column that is used more than once in
    a projection of its own instead of repeating it.
    """
    staged = df.withColumn("_raw", raw_amount(F.col(price), F.col(delta))).withColumn(
        "_amount", decimal64(F.col("_raw"))
    )
    low, high = _edges(F.col(price), F.col("_amount"))
    return (
        staged.withColumn("low_price", low)
        .withColumn("high_price", high)
        .drop("_raw", "_amount")
    )
