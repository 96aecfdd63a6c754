"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` so that later expressions read values, not formulas.

    Spark pushes filters below projections by copying the formulas of the
    columns they use, and then evaluates every copy.  Columns that come out of
    a generator stay where they are, so a costly one (parsing JSON, judging a
    row from several states) is evaluated once per row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
