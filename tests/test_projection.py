import random

from pyspark.sql import functions as F

from bandstream.operators import projection
from bandstream.operators.ticks import tick_direction


def simulate(written, ttl, every, start, stop):
    expires, at = written + ttl, start + every
    while at <= stop and at < written + 100_000:
        if written < at < expires:
            expires = at + ttl
        at += every
    return expires


def test_closed_form_equals_stepping(spark):
    rng = random.Random(3)
    for _ in range(12):
        ttl, every = rng.randrange(1, 60), rng.randrange(1, 60)
        start, stop = rng.randrange(0, 50), rng.randrange(50, 400)
        times = [(rng.randrange(0, 400),) for _ in range(200)]
        expr = projection.expires_at(
            F.col("w"), ttl_ms=ttl, renew_ms=every, renew_from=start, renew_until=stop
        )
        for r in spark.createDataFrame(times, "w long").select("w", expr.alias("e")).collect():
            assert r["e"] == simulate(r["w"], ttl, every, start, stop), (ttl, every, start, stop)


def test_endless_renewal_never_expires(spark):
    expr = projection.expires_at(F.lit(7).cast("long"), ttl_ms=10, renew_ms=4)
    assert spark.range(1).select(expr).first()[0] is None
    expr = projection.expires_at(F.lit(7).cast("long"), ttl_ms=4, renew_ms=10)
    assert spark.range(1).select(expr).first()[0] == 14


def test_served_rows(spark):
    rows = [("A", 10), ("B", 20), ("C:phantom", 99), (None, 99), ("D", None)]
    df = spark.createDataFrame(rows, "symbol_pair string, expires_at long")
    got = sorted(r["symbol_pair"] for r in projection.alive(df, 10).collect())
    assert got == ["B", "D"]


def test_pages(spark):
    rows = [(f"S{i:02}", i % 4 if i % 5 else None) for i in range(23)]
    df = spark.createDataFrame(rows, "symbol_pair string, v int")
    for desc in (False, True):
        seen = []
        for number in range(4):
            seen += [tuple(r) for r in projection.page(df, number, 7, "v", desc).collect()]
        order = sorted(rows, key=lambda r: (r[1] is None, (-(r[1] or 0) if desc else r[1] or 0), r[0]))
        assert seen == order
        walked, after = [], None
        while True:
            got = [tuple(r) for r in projection.page_after(df, after, 7, "v", desc).collect()]
            if not got:
                break
            walked += got
            after = (got[-1][1], got[-1][0])
        assert walked == order
    assert projection.page(df, 9, 7).isEmpty()
    assert tuple(projection.page_meta(df, 3, 7).first()) == (3, 7, 23, 4, False, True)
    assert tuple(projection.page_meta(df.limit(0), 0, 7).first()) == (0, 7, 0, 0, True, True)


def test_page_index(spark, tmp_path):
    rows = [(f"S{i:02}", i % 4 if i % 5 else None) for i in range(23)]
    df = spark.createDataFrame(rows, "symbol_pair string, v int")
    for desc in (False, True):
        index = projection.PageIndex(spark, str(tmp_path / f"{desc}"), df.schema, block_rows=5)
        index.write(df, "v", desc)
        for number in range(5):
            want = projection.page(df, number, 7, "v", desc).collect()
            assert index.page(number, 7).collect() == want
        one = index.page(2, 4)  # ranks 8 to 11
        assert len({f.split("block=")[1].split("/")[0] for f in one.inputFiles()}) == 5
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(block" in plan and "Limit" not in plan
        scanned = index.rows().where("block BETWEEN 1 AND 2")
        assert scanned.count() == 10
    empty = projection.PageIndex(spark, str(tmp_path / "empty"), df.schema)
    empty.write(df.limit(0))
    assert empty.page().isEmpty()
    index.write(df.limit(3))
    assert index.rows().count() == 3


def test_direction(spark):
    rows = [("A", 1, 5.0), ("A", 2, 5.0), ("A", 3, 6.0), ("A", 4, None), ("A", 5, 1.0), ("A", 6, 0.5)]
    df = spark.createDataFrame(rows, "symbol_pair string, seq long, price double")
    for sizes in ({}, {"limit": 1}):
        got = [r["direction"] for r in tick_direction(df, **sizes).orderBy("seq").collect()]
        assert got == [None, None, "up", None, None, "down"]
