"""Running state per key, without ever making one key one task.

A window over ``key`` ordered by ``seq`` puts all rows of a key into one task.
A key with more than ``limit`` rows, which is what a task should hold and does
not depend on the table, is cut into segments along ``seq``:

1. count rows per key (map-side combined) and store the keys above the limit;
2. range partition the rows of those keys by (key, seq) into pieces of at most about
   ``PIECE_ROWS`` rows, sort each, cut it every ``limit`` rows into segments, store them;
   a piece may hold many segments, so that a low limit does not make more tasks;
3. run the windows per (key, segment);
4. carry the state at the end of every segment into the later ones.

The hot keys stay a table, however many there are, and nothing is broadcast by
hand.  Where the borders fall does not matter: any borders give the same result.

Every running value is the running *maximum* of an orderable column, usually a
struct that starts with what it is ordered by.  A maximum combines across
segments, which running windows in general do not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandstream.session import stored

#: Rows of one key that one task may hold.
TASK_ROWS = 1_000_000
#: Rows of one range partition; where ``limit`` is greater, that many.
PIECE_ROWS = 200_000
SEGMENT = "_segment"


@dataclass(frozen=True)
class Cuts:
    """The keys too large for one task (a stored table), or None if there is none."""

    key: str
    hot: DataFrame | None = None
    pieces: int = 0
    limit: int = TASK_ROWS


def hot_cuts(df: DataFrame, key: str, limit: int = TASK_ROWS) -> Cuts:
    """Find the keys with more than ``limit`` rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = stored(counts.where(F.col("_rows") > limit), "hot-keys")
    rows = hot.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return Cuts(key)
    return Cuts(key, hot.select(key), max(2, -(-rows // max(limit, PIECE_ROWS))), limit)


@dataclass(frozen=True)
class Timeline:
    """Rows of a table, to be read per ``key`` in ``seq`` order."""

    df: DataFrame
    key: str
    seq: str
    cut: bool

    def with_columns(self, columns: dict[str, Column]) -> "Timeline":
        return Timeline(self.df.withColumns(columns), self.key, self.seq, self.cut)

    def rows(self) -> DataFrame:
        return self.df.drop(SEGMENT)

    def prior(self, within: tuple[str, ...] = (), **values: Column) -> "Timeline":
        """Add, per name, the maximum of the value over all earlier rows of the key.

        ``within`` narrows that to the earlier rows with the same values in these
        columns, without another shuffle; they must not be null.

        Nulls do not count; the result is null where no earlier row has a value.
        The row's own value is added too, as ``{name}_own``: it has to cross the
        shuffle anyway, so reading it there spares the columns it is made of.
        """
        df = self.df.withColumns({f"{name}_own": value for name, value in values.items()})
        key = [self.key, *within]
        groups = [*key, SEGMENT] if self.cut else key
        before = (
            Window.partitionBy(*groups)
            .orderBy(self.seq)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        out = df.withColumns({n: F.max(f"{n}_own").over(before) for n in values})
        if self.cut:
            ends = (
                df.where(F.col(SEGMENT) > 0)
                .groupBy(*key, SEGMENT)
                .agg(*[F.max(f"{n}_own").alias(f"{n}_in") for n in values])
            )
            earlier = (
                Window.partitionBy(*key)
                .orderBy(SEGMENT)
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            carried = ends.withColumns(
                {f"{n}_in": F.max(f"{n}_in").over(earlier) for n in values}
            )
            out = out.join(carried, [*key, SEGMENT], "left")
            out = out.withColumns({n: F.greatest(n, f"{n}_in") for n in values})
            out = out.drop(*[f"{n}_in" for n in values])
        return Timeline(out, self.key, self.seq, self.cut)


def timeline(
    df: DataFrame,
    key: str = "symbol_pair",
    seq: str = "seq",
    cuts: Cuts | None = None,
    limit: int = TASK_ROWS,
) -> Timeline:
    """Prepare ``df`` for running state; ``cuts`` skips the search for hot keys.

    ``seq`` must be unique per key.
    """
    if cuts is None:
        cuts = hot_cuts(df, key, limit)
    if cuts.hot is None:
        return Timeline(df, key, seq, False)
    keys = cuts.hot.select(F.col(cuts.key).alias(key), F.lit(True).alias("_hot"))
    marked = df.join(keys, key, "left")
    cold = marked.where(F.col("_hot").isNull()).withColumn(SEGMENT, F.lit(0).cast("long"))
    dealt = marked.where("_hot").repartitionByRange(cuts.pieces, key, seq)
    # the id counts the sorted rows of a piece in its lower 33 bits, the piece is above
    at = F.monotonically_increasing_id()
    inside = at.bitwiseAND(F.lit((1 << 33) - 1))
    segment = at - inside + F.floor(inside / cuts.limit) + 1
    # stored, because all readers must see the same borders
    hot = stored(dealt.sortWithinPartitions(key, seq).withColumn(SEGMENT, segment), "segments")
    return Timeline(cold.unionByName(hot).drop("_hot"), key, seq, True)


def number_rows(
    df: DataFrame,
    seq: str | list[Column] = "seq",
    name: str = "position",
    parts: int | None = None,
) -> DataFrame:
    """Number all rows 0, 1, 2, … by ``seq`` without one task sorting them all.

    ``seq`` may be a list of orders (``F.col(…).desc_nulls_last()``, …).

    The rows are range partitioned, sorted and numbered inside each partition,
    stored once, and shifted by the sizes of the earlier partitions.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id counts rows in its lower 33 bits and has the partition above them
    order = [seq] if isinstance(seq, str) else seq
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    piece = F.shiftright("_id", 33)
    sizes = dealt.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(  # one row per partition
        "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        dealt.withColumn("_piece", piece)
        .join(shifts, "_piece")
        .withColumn(name, F.col("_shift") + inside)
        .drop("_id", "_piece", "_shift")
    )
