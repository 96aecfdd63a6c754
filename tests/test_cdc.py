from decimal import Decimal

from pyspark.sql import functions as F

from bandstream.schemas import CONFIG_EVENT, CONFIG_EVENT_WIRE, KAFKA_ROW
from bandstream.sources import cdc, records

CREATED = [("eventType", b"PriceConfigCreated")]
GOOD = '{"id":7,"symbolPair":"A-B","deltaPercent":0.5,"updatedAt":"2024-01-15T00:00:00.123Z"}'


def messages(spark, *rows):
    whole = [("t", 0, i, None, f"k{i}", value, headers) for i, (value, headers) in enumerate(rows)]
    return spark.createDataFrame(whole, KAFKA_ROW)


def one(spark, value, headers=CREATED):
    return cdc.classify(messages(spark, (value, headers))).first()


def test_plain_and_wrapped_documents_read_alike(spark):
    for value in (GOOD, f'{{"payload":{GOOD}}}'):
        got = one(spark, value)
        assert got["reason"] is None
        assert (got["id"], got["symbol_pair"]) == (7, "A-B")
        assert got["delta_percent"] == Decimal("0.500000")
        assert got["config_event_at"] == 1705276800123
        assert got["deleted"] is False


def test_number_texts_are_accepted(spark):
    got = one(spark, '{"id":"12","symbolPair":"A","deltaPercent":"1E-6","updatedAt":null}')
    assert (got["id"], got["delta_percent"], got["config_event_at"]) == (12, Decimal("0.000001"), 0)


def test_absent_fields_are_null(spark):
    got = one(spark, '{"symbolPair":"A"}')
    assert got["reason"] is None
    assert (got["id"], got["delta_percent"], got["config_event_at"]) == (None, None, 0)


def test_reasons(spark):
    cases = {
        "tombstone": (None, CREATED),
        "no event type": (GOOD, []),
        "unknown event type": (GOOD, [("eventType", b"Other")]),
        "not json": ("{", CREATED),
        "bad id": (GOOD.replace("7", '"x"', 1), CREATED),
        "bad delta": (GOOD.replace("0.5", '"x"'), CREATED),
        "bad time": (GOOD.replace("T00:00:00.123Z", ""), CREATED),
        "no symbol": (GOOD.replace('"A-B"', "null"), CREATED),
    }
    got = cdc.cdc_rejects(messages(spark, *cases.values())).orderBy("offset").collect()
    assert [r["reason"] for r in got] == list(cases)
    for value in ('{"payload":null}', '{"payload":"text"}', "[1]", "3"):
        assert one(spark, value)["reason"] == "no symbol"


def test_last_header_wins(spark):
    twice = [("eventType", b"Other"), ("x", b"1"), ("eventType", b"PriceConfigDeleted")]
    assert one(spark, GOOD, twice)["deleted"] is True
    assert one(spark, GOOD, None)["reason"] == "no event type"


def test_order_inside_a_partition(spark):
    rows = [("t", p, o, None, "k", GOOD, CREATED) for p in (0, 1) for o in (5, 6)]
    got = spark.createDataFrame(rows, KAFKA_ROW).select("partition", "offset", records.arrival().alias("n"))
    by = {(r["partition"], r["offset"]): r["n"] for r in got.collect()}
    assert len(set(by.values())) == 4
    assert by[0, 5] < by[0, 6] and by[1, 5] < by[1, 6]


def test_routing_round_trip(spark):
    outbox = spark.createDataFrame(
        [(1, "u-1", "PRICE_CONFIG", "7", "PriceConfigDeleted", GOOD)],
        "id long, event_id string, aggregatetype string, aggregateid string, type string, payload string",
    )
    sent = cdc.route_outbox(outbox)
    row = sent.first()
    assert (row["topic"], row["key"], row["value"]) == ("PRICE_CONFIG.events", "7", GOOD)
    assert [(h["key"], bytes(h["value"])) for h in row["headers"]] == [
        ("id", b"u-1"),
        ("eventType", b"PriceConfigDeleted"),
    ]
    back = cdc.parse_cdc(sent.withColumn("partition", F.lit(0))).first()
    assert back["deleted"] is True and back["id"] == 7


def test_unreadable_snapshot_records_go_to_quarantine(spark):
    good = '{"id":1,"symbolPair":"A","deltaPercent":0.5,"configEventAt":9,"deleted":false}'
    rows = [("A", good, 1), ("B", "junk", 2), ("C", '{"id":"x"}', 3), ("D", None, 4)]
    df = spark.createDataFrame(rows, "key string, value string, seq long")
    assert [r["seq"] for r in records.snapshot_scan(df).collect()] == [1]
    bad = records.bad_records(df, CONFIG_EVENT, CONFIG_EVENT_WIRE)
    assert sorted(r["seq"] for r in bad.collect()) == [2, 3]


def test_changelog_records_keep_earlier_state_past_a_bad_one(spark):
    row = '{"symbolPair":"A","configId":1,"price":1.5,"deltaPercent":1,"lowPrice":1,"highPrice":2,"priceAt":3,"configEventAt":4}'
    rows = [("A", row, 1), ("A", "junk", 2), ("B", row, 3), ("B", None, 4), (None, row, 5)]
    df = spark.createDataFrame(rows, "key string, value string, seq long")
    got = [(r["symbol_pair"], r["op"], r["seq"]) for r in records.changelog_scan(df).orderBy("seq").collect()]
    assert got == [("A", "U", 1), ("B", "U", 3), ("B", "D", 4)]


def test_prices_without_symbol_are_not_published(spark):
    ticks = spark.sql("select 'A' symbol_pair, 1.5BD price, 1L seq union all select null, 2BD, 2L")
    got = records.publish_prices(ticks, F.lit(99)).collect()
    assert [(r["key"], r["value"]) for r in got] == [
        ("A", '{"symbolPair":"A","price":1.5,"priceAt":99}')
    ]
    back = records.price_scan(records.publish_prices(ticks, F.lit(99)))
    assert [tuple(r) for r in back.collect()] == [("A", Decimal("1.5"), 99, False, 1)]


def test_scans_take_kafka_shaped_rows(spark):
    """The typed scans number rows by offset and partition; headers reach the sink."""
    rows = [
        ("t", 1, 5, None, "A", '{"symbolPair":"A","price":2.5,"priceAt":7}', None),
        ("t", 0, 6, None, "A", None, None),
    ]
    raw = spark.createDataFrame(rows, KAFKA_ROW)
    ticks = {r["seq"]: r for r in records.price_scan(raw).collect()}
    assert set(ticks) == {(5 << 16) + 1, 6 << 16}
    assert ticks[6 << 16]["deleted"] and ticks[(5 << 16) + 1]["price_at"] == 7
    assert records.snapshot_scan(raw).columns[-1] == "seq"
    assert {r["op"] for r in records.changelog_scan(raw).collect()} == {"U", "D"}
    assert records._sink_columns(raw) == ["topic", "key", "value", "headers"]


def test_two_topics_never_share_a_number(spark):
    from bandstream.operators.latest import tag_topics

    config = spark.createDataFrame([("A", 1, 9)], "symbol_pair string, id long, seq long")
    price = spark.createDataFrame([("A", 9)], "symbol_pair string, seq long")
    got = {r["side"]: r["seq"] for r in tag_topics(config, price).collect()}
    assert got == {"C": 18, "P": 19}
