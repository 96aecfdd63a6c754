import random
from decimal import Decimal

import model
from pyspark.sql import functions as F

from bandstream.functions import text
from bandstream.functions.numeric import add_band, as_delta, as_price, band

SHAPE = "price decimal(24,8), delta_percent decimal(9,6)"


def test_known_value_needs_sixteen_digits(spark):
    rows = [(Decimal("130122005.937"), Decimal("797.94765"))]
    low, high = band(F.col("price"), F.col("delta_percent"))
    got = spark.createDataFrame(rows, SHAPE).select(low, high).first()
    assert got[0] == Decimal("-908183482.57015200")
    assert got[1] == Decimal("1168427494.44415200")


def test_random_bands_match_decimal_arithmetic(spark):
    rng, rows = random.Random(7), [(None, Decimal(1)), (Decimal(1), None), (Decimal(0), Decimal(0))]
    for _ in range(4000):
        digits = rng.randrange(1, 25)
        price = Decimal(rng.randrange(10**digits)).scaleb(-8)
        delta = Decimal(rng.randrange(10 ** rng.randrange(1, 10))).scaleb(-6)
        rows.append((price * rng.choice([1, 1, 1, -1]), delta))
    got = add_band(spark.createDataFrame(rows, SHAPE)).collect()
    for r in got:
        assert (r["low_price"], r["high_price"]) == model.band(r["price"], r["delta_percent"])


def test_scaling_is_half_up_and_null_beyond_range(spark):
    df = spark.createDataFrame([("1.000000005", "0.0000005"), ("1E-7", "1000")], "p string, d string")
    got = df.select(as_price(F.col("p")), as_delta(F.col("d"))).collect()
    assert got[0] == (Decimal("1.00000001"), Decimal("0.000001"))
    assert got[1] == (Decimal("0.00000010"), None)


def test_display(spark):
    df = spark.createDataFrame(
        [(Decimal("1234.565"),), (Decimal("1.00005"),), (Decimal("0.5"),), (Decimal("-2000"),), (None,)],
        "v decimal(24,8)",
    )
    got = [r[0] for r in df.select(text.format_price(F.col("v"))).collect()]
    assert got == ["1,234.57", "1.0001", "0.50000000", "-2,000.00000000", "—"]
    names = spark.createDataFrame([("BTC-USDT",), ("ETHER/BTC",), ("",), (None,)], "s string")
    assert [r[0] for r in names.select(text.base_symbol(F.col("s"))).collect()] == ["BTC", "ETHE", "", ""]
    times = spark.createDataFrame([(0,), (None,), (1705276800000,)], "t long")
    got = [r[0] for r in times.select(text.format_time(F.col("t"))).collect()]
    assert got == ["—", "—", "1/15/2024, 12:00:00 AM"]
