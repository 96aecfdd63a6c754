import json

from bandstream.operators import push
from bandstream.schemas import CHANGELOG
from bandstream.session import scratch_path
from bandstream.sources.store import CompactedChangelog
from bandstream.streaming import sinks


def changes(spark, *ops):
    rows = [
        (symbol, 1, None, None, None, None, seq, 0, op, seq) for seq, (op, symbol) in enumerate(ops)
    ]
    return spark.createDataFrame(rows, CHANGELOG)


def payloads(spark, ops, size):
    df = push.push_payload(push.poll_batches(changes(spark, *ops), size))
    return [json.loads(r["payload"]) for r in df.orderBy("batch").collect()]


def names(payload):
    return [(p["symbolPair"], p.get("deleted", False)) for p in payload]


def test_collapsed_with_upserts_first_in_arrival_order(spark):
    ops = [("U", "A"), ("D", "B"), ("U", "C"), ("D", "A"), ("U", "A"), ("U", "C"), ("D", "D")]
    got = payloads(spark, ops, 100)
    assert names(got[0]) == [("C", False), ("A", False), ("B", True), ("D", True)]
    assert got[0][0]["priceAt"] == 5 and got[0][0]["price"] is None


def test_batches_are_separate(spark):
    ops = [("U", "A"), ("U", "B"), ("D", "A")]
    assert [names(p) for p in payloads(spark, ops, 2)] == [
        [("A", False), ("B", False)],
        [("A", True)],
    ]


def test_envelope(spark):
    df = push.push_payload(push.poll_batches(changes(spark, ("U", "A"))), channel='a"b')
    row = push.push_envelope(df).first()
    sent = json.loads(row["request"])
    assert sent["method"] == "publish" and sent["params"]["channel"] == 'a"b'
    assert sent["params"]["data"] == json.loads(bytes(row["data"]).decode())


def test_transport_errors_are_dropped_and_nothing_is_sent_for_nothing(spark, tmp_path):
    target = str(tmp_path)

    def transport(channel, payload):
        import pathlib
        import uuid

        pathlib.Path(target, uuid.uuid4().hex).write_text(payload)
        raise RuntimeError("unreachable")

    df = push.push_payload(push.poll_batches(changes(spark, ("U", "A"), ("U", "B")), 1))
    push.push(df, transport)
    assert len(list(tmp_path.iterdir())) == 2
    push.push(df.limit(0), transport)
    assert len(list(tmp_path.iterdir())) == 2


def test_sink_stores_even_when_the_push_fails(spark):
    def transport(channel, payload):
        raise RuntimeError("unreachable")

    store = CompactedChangelog(spark, scratch_path(spark, "push"), CHANGELOG)
    write = sinks.project_into(store, transport)
    batch = changes(spark, ("U", "A"), ("D", "B"), ("U", "B"), ("D", "A"))
    write(batch, 0)
    write(batch, 0)
    assert [r["symbol_pair"] for r in store.read().collect()] == ["B"]
    assert store.changes().count() == 2
    counts = sinks.batch_metrics(push.poll_batches(batch, 3)).orderBy("batch").collect()
    assert [tuple(r) for r in counts] == [(0, 3, 2, 2, 0), (1, 1, 1, 0, 1)]
