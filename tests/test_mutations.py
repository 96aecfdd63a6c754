import random
from decimal import Decimal

import model
import pytest
from pyspark.sql import functions as F

from bandstream.operators.mutations import apply_requests, validation_errors
from bandstream.schemas import OUTBOX, PRICE_CONFIG
from bandstream.session import scratch_path
from bandstream.sources.tables import commit_together, find_by, lookup, read_committed

REQUEST = "seq long, op string, id long, symbol_pair string, delta_percent decimal(38,18)"
CONFIG = "id long, symbol_pair string, delta_percent decimal(9,6), updated_at timestamp"


def table(spark, configs):
    rows = [(i, s, d) for i, (s, d) in configs.items()]
    df = spark.createDataFrame(rows, "id long, symbol_pair string, delta_percent decimal(9,6)")
    return df.withColumn("updated_at", F.timestamp_millis(F.lit(1000)))


def log(spark, rows):
    return spark.createDataFrame(
        [(r["seq"], r["op"], r["id"], r["symbol_pair"], r["delta_percent"]) for r in rows], REQUEST
    )


def apply(spark, configs, rows, **sizes):
    at = F.timestamp_millis(F.col("seq") + 2000)
    return apply_requests(table(spark, configs), log(spark, rows), at, F.col("seq").cast("string"), **sizes)


def random_requests(seed, size, ids=8, symbols=10):
    rng, rows = random.Random(seed), []
    for seq in range(size):
        op = rng.choice(["create", "update", "update", "update", "update", "delete"])
        symbol = "HOT" if rng.random() < 0.35 else f"S{rng.randrange(symbols)}"
        rows.append(
            {
                "seq": seq,
                "op": op,
                "id": None if op == "create" else rng.randrange(1, ids + 2),
                "symbol_pair": None if op == "delete" else symbol,
                "delta_percent": None if op == "delete" else Decimal(rng.randrange(9)),
            }
        )
    return rows


@pytest.mark.parametrize("sizes", [{}, {"limit": 3}], ids=["whole", "cut"])
@pytest.mark.parametrize("seed,size,ids", [(1, 40, 8), (2, 90, 8), (3, 90, 20)])
def test_same_as_one_after_the_other(spark, seed, size, ids, sizes):
    configs = {i: (f"S{i}", Decimal(i)) for i in range(1, 9)}
    rows = random_requests(seed, size, ids, symbols=14)
    want, end = model.apply_requests(configs, rows)
    done = apply(spark, configs, rows, **sizes)
    got = {r["seq"]: (r["status"], r["id"] if r["status"] != 409 or r["op"] != "create" else None) for r in done.results.collect()}
    assert got == want
    assert {r["id"]: (r["symbol_pair"], r["delta_percent"]) for r in done.configs.collect()} == end
    accepted = sorted(s for s, (code, _) in want.items() if code < 300)
    events = done.outbox.orderBy("id").collect()
    assert [int(r["event_id"]) for r in events] == accepted
    assert [r["id"] for r in events] == list(range(1, len(accepted) + 1))


def request(seq, op, row_id, symbol=None):
    delta = None if op == "delete" else Decimal(seq % 9)
    return {"seq": seq, "op": op, "id": row_id, "symbol_pair": symbol, "delta_percent": delta}


def test_rows_created_in_the_same_log_can_be_updated_and_deleted(spark):
    rows = [
        request(1, "update", 2, "B"),  # not yet there
        request(2, "create", None, "A"),  # taken
        request(3, "create", None, "B"),  # 2
        request(4, "update", 2, "C"),
        request(5, "create", None, "B"),  # 3, free again
        request(6, "update", 3, "C"),  # taken
        request(7, "delete", 2),
        request(8, "update", 3, "C"),
        request(9, "delete", 2),  # gone
        request(10, "update", 4, "D"),  # never there
        request(11, "delete", 3),
        request(12, "create", None, "C"),  # 4
    ]
    done = apply(spark, {1: ("A", Decimal(1))}, rows)
    assert {r["seq"]: r["status"] for r in done.results.collect()} == {
        1: 404, 2: 409, 3: 201, 4: 200, 5: 201, 6: 409, 7: 204, 8: 200, 9: 404, 10: 404, 11: 204, 12: 201,
    }
    assert {r["id"]: r["symbol_pair"] for r in done.configs.collect()} == {1: "A", 4: "C"}
    removed = [r["payload"] for r in done.outbox.collect() if r["type"] == "PriceConfigDeleted"]
    assert [p.split(",")[1] for p in sorted(removed)] == ['"symbolPair":"C"', '"symbolPair":"C"']


def test_a_long_chain_on_one_symbol_takes_few_steps(spark):
    """Each row takes the symbol and goes home again; every second try comes too early."""
    count = 2500
    configs = {i: (f"S{i}", Decimal(1)) for i in range(1, count + 1)}
    rows = []
    for i in range(1, count + 1):
        rival = i % count + 1
        rows += [
            request(4 * i, "update", i, "HOT"),
            request(4 * i + 1, "update", rival, "HOT"),
            request(4 * i + 2, "update", i, f"S{i}"),
            request(4 * i + 3, "update", rival, f"S{rival}"),
        ]
    want, end = model.apply_requests(configs, rows)
    done = apply(spark, configs, rows, limit=3000)
    assert {r["seq"]: (r["status"], r["id"]) for r in done.results.collect()} == want
    assert {r["id"]: (r["symbol_pair"], r["delta_percent"]) for r in done.configs.collect()} == end
    assert done.rounds + done.steps <= 20


def test_rounds_read_less_and_less(spark):
    configs = {i: (f"S{i}", Decimal(1)) for i in range(1, 61)}
    # ten pairs: the second row moves to where the first one fails to leave
    rows = []
    for i in range(1, 21, 2):
        rows += [request(10 * i, "update", i, "S60"), request(10 * i + 1, "update", i + 1, f"S{i}")]
    rows += [request(1000 + i, "update", i, f"N{i}") for i in range(21, 60)]
    want, _ = model.apply_requests(configs, rows)
    done = apply(spark, configs, rows)
    assert {r["seq"]: (r["status"], r["id"]) for r in done.results.collect()} == want
    assert list(done.work) == sorted(done.work, reverse=True)
    assert len(done.work) == 1 or done.work[-1] < done.work[0]


def test_delete_carries_the_row_it_removed_and_updates_touch(spark):
    rows = [
        {"seq": 1, "op": "update", "id": 1, "symbol_pair": "B", "delta_percent": Decimal("2")},
        {"seq": 2, "op": "delete", "id": 1, "symbol_pair": None, "delta_percent": None},
        {"seq": 3, "op": "delete", "id": 1, "symbol_pair": None, "delta_percent": None},
        {"seq": 4, "op": "delete", "id": 2, "symbol_pair": None, "delta_percent": None},
    ]
    done = apply(spark, {1: ("A", Decimal(1)), 2: ("C", Decimal(1))}, rows)
    assert [r["payload"] for r in done.outbox.orderBy("id").collect()] == [
        '{"id":1,"symbolPair":"B","deltaPercent":2.000000,"updatedAt":"1970-01-01T00:00:02.001000Z"}',
        '{"id":1,"symbolPair":"B","deltaPercent":2.000000,"updatedAt":"1970-01-01T00:00:02.001000Z"}',
        '{"id":2,"symbolPair":"C","deltaPercent":1.000000,"updatedAt":"1970-01-01T00:00:01Z"}',
    ]
    assert done.configs.isEmpty()
    codes = {r["seq"]: (r["status"], r["error_code"]) for r in done.results.collect()}
    assert codes[3] == (404, "PRICE_CONFIG_NOT_FOUND")


def test_invalid_requests_are_refused_first(spark):
    rows = [
        {"seq": 1, "op": "update", "id": 99, "symbol_pair": " ", "delta_percent": Decimal("1")},
        {"seq": 2, "op": "create", "id": None, "symbol_pair": "x" * 33, "delta_percent": None},
        {"seq": 3, "op": "create", "id": None, "symbol_pair": "N", "delta_percent": Decimal("-1")},
        {"seq": 4, "op": "create", "id": None, "symbol_pair": "N", "delta_percent": Decimal("1000")},
        {"seq": 5, "op": "create", "id": None, "symbol_pair": "N", "delta_percent": Decimal("0.1234567")},
        {"seq": 6, "op": "create", "id": None, "symbol_pair": "N", "delta_percent": Decimal("999.999999")},
    ]
    errors = {(r["seq"], r["field"]): r["message"] for r in validation_errors(log(spark, rows)).collect()}
    digits = "numeric value out of bounds (<3 digits>.<6 digits> expected)"
    assert errors == {
        (1, "symbolPair"): "must not be blank",
        (2, "symbolPair"): "size must be between 0 and 32",
        (2, "deltaPercent"): "must not be null",
        (3, "deltaPercent"): "must be greater than or equal to 0",
        (4, "deltaPercent"): digits,
        (5, "deltaPercent"): digits,
    }
    done = apply(spark, {1: ("A", Decimal(1))}, rows)
    assert {r["seq"]: r["status"] for r in done.results.collect()} == {
        1: 400, 2: 400, 3: 400, 4: 400, 5: 400, 6: 201,
    }


def test_rename_can_emit_a_delete_for_the_old_symbol(spark):
    rows = [
        {"seq": 1, "op": "update", "id": 1, "symbol_pair": "B", "delta_percent": Decimal("2")},
        {"seq": 2, "op": "update", "id": 1, "symbol_pair": "B", "delta_percent": Decimal("3")},
    ]
    done = apply(spark, {1: ("A", Decimal(1))}, rows, rename_tombstones=True)
    got = [(r["type"], '"A"' in r["payload"]) for r in done.outbox.orderBy("id").collect()]
    assert got == [
        ("PriceConfigDeleted", True),
        ("PriceConfigUpdated", False),
        ("PriceConfigUpdated", False),
    ]


def test_table_and_outbox_commit_as_one(spark):
    rows = [{"seq": 1, "op": "create", "id": None, "symbol_pair": "B", "delta_percent": Decimal("2")}]
    path = scratch_path(spark, "unit")
    done = apply(spark, {1: ("A", Decimal(1))}, rows)
    unit = {"configs": done.configs, "outbox": done.outbox}
    commit_together(path, 0, unit)
    commit_together(path, 0, unit)
    done.outbox.write.parquet(f"{path}/outbox/batch_id=1")
    table_ = read_committed(spark, path, "configs", PRICE_CONFIG)
    assert sorted(r["symbol_pair"] for r in table_.collect()) == ["A", "B"]
    assert read_committed(spark, path, "outbox", OUTBOX, whole=True).count() == 1


def test_lookups(spark):
    configs = table(spark, {1: ("A", Decimal(1)), 2: ("B", Decimal(2))})
    keys = spark.createDataFrame([("B",), ("Z",)], "symbol_pair string")
    got = {r["symbol_pair"]: (r["found"], r["id"]) for r in lookup(configs, keys).collect()}
    assert got == {"B": (True, 2), "Z": (False, None)}
    assert find_by(configs, "id", 1).first()["symbol_pair"] == "A"


def test_a_log_cut_into_slices_has_the_same_outcomes(spark):
    """Ids that earlier slices made are known in later ones, deleted rows stay gone."""
    configs = {i: (f"S{i}", Decimal(i)) for i in range(1, 9)}
    rows = random_requests(4, 120, 40, symbols=30)
    want, end = model.apply_requests(configs, rows)
    done = apply(spark, configs, rows, first_slice=8)
    # at first only the first slice is judged
    assert done.work[0] <= 8 + len(configs)
    got = {r["seq"]: (r["status"], r["id"] if r["status"] != 409 or r["op"] != "create" else None) for r in done.results.collect()}
    assert got == want
    assert {r["id"]: (r["symbol_pair"], r["delta_percent"]) for r in done.configs.collect()} == end
    accepted = sorted(s for s, (code, _) in want.items() if code < 300)
    events = done.outbox.orderBy("id").collect()
    assert [int(r["event_id"]) for r in events] == accepted
