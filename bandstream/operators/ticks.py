"""Reading ticks against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandstream.operators.runs import timeline


def tick_direction(ticks: DataFrame, **sizes) -> DataFrame:
    """Add ``direction``: up or down against the previous tick of the symbol.

    Null for the first tick, for an equal price, and next to a tick without
    price.
    """
    rows = ticks.where(F.col("symbol_pair").isNotNull())
    line = timeline(rows, **sizes).prior(_last=F.struct("seq", "price"))
    move = F.col("price") - F.col("_last.price")
    return line.rows().withColumn(
        "direction", F.when(move > 0, "up").when(move < 0, "down")
    ).drop("_last", "_last_own")
