import random

from pyspark.sql import functions as F

from bandstream.operators.runs import SEGMENT, hot_cuts, number_rows, timeline


def skewed(spark, size=20_000):
    """One key with a third of the rows, and sequence numbers with large gaps."""
    key = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    gap = F.col("id") + F.when(F.col("id") > size / 2, F.lit(1 << 40)).otherwise(F.lit(0))
    return spark.range(size).select(key.alias("key"), gap.alias("seq"))


def test_cold_tables_are_left_alone(spark):
    cuts = hot_cuts(skewed(spark), "key")
    assert cuts.hot is None
    assert not timeline(skewed(spark), "key", "seq", cuts).cut


def test_hot_key_is_cut_into_even_pieces(spark):
    df = skewed(spark)
    cuts = hot_cuts(df, "key", limit=330)
    assert [r["key"] for r in cuts.hot.collect()] == ["HOT"]
    pieces = timeline(df, "key", "seq", cuts).df.where(F.col(SEGMENT) > 0)
    sizes = [r["count"] for r in pieces.groupBy(SEGMENT).count().collect()]
    assert sum(sizes) == df.where("key = 'HOT'").count()
    assert 18 <= len(sizes) <= 22 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_the_limit_does_not_depend_on_the_table(spark):
    """A key far below any share of the table is cut once it is above the limit."""
    key = F.when(F.col("id") < 50, F.lit("small")).otherwise(F.col("id").cast("string"))
    df = spark.range(200_000).select(key.alias("key"), F.col("id").alias("seq"))
    line = timeline(df, "key", "seq", limit=20)
    segments = line.df.where(F.col(SEGMENT) > 0).select("key", SEGMENT).distinct().collect()
    assert {r["key"] for r in segments} == {"small"} and len(segments) >= 2
    got = line.prior(m=F.col("seq")).rows().where("key = 'small' AND m != seq - 1")
    assert got.isEmpty()


def test_a_low_limit_makes_segments_and_not_tasks(spark):
    df = skewed(spark)
    cuts = hot_cuts(df, "key", limit=10)
    assert cuts.pieces == 2
    segments = timeline(df, "key", "seq", cuts).df.where(F.col(SEGMENT) > 0).groupBy("key", SEGMENT).count()
    sizes = [r["count"] for r in segments.collect()]
    assert max(sizes) <= 10 and len(sizes) >= sum(sizes) / 10
    got = timeline(df, "key", "seq", cuts).prior(m=F.col("seq")).rows()
    assert got.where("key = 'HOT' AND m >= seq").isEmpty() and got.where("key = 'HOT' AND m IS NULL").count() == 1


def test_running_maximum_is_the_same_with_and_without_cuts(spark):
    df = skewed(spark, 5000).withColumn("v", F.xxhash64("seq"))
    whole = timeline(df, "key", "seq").prior(m=F.col("v")).rows()
    cut = timeline(df, "key", "seq", limit=15).prior(m=F.col("v")).rows().select(*whole.columns)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_rows_are_numbered_in_order_across_pieces(spark):
    values = random.Random(1).sample(range(1 << 50), 3000)
    df = spark.createDataFrame([(v,) for v in values], "seq long")
    got = {r["seq"]: r["position"] for r in number_rows(df, parts=50).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    small = {r["seq"]: r["position"] for r in number_rows(df).collect()}
    assert small == got


def test_numbering_uses_many_tasks(spark):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    numbered = number_rows(df, parts=50)
    assert numbered.where("position <> seq").isEmpty()


def test_numbering_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(4000).withColumnRenamed("id", "seq").repartition(3)
    numbered = number_rows(df.mapInArrow(look, df.schema), parts=8)
    assert numbered.count() == 4000
    # once for the rows, once for the sample that sets the borders of the ranges
    assert seen.value <= 8000
