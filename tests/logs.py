"""Small logs for the tests."""

import random
from decimal import Decimal

from bandstream.schemas import TAGGED_LOG


def row(seq, side, symbol="A", **values):
    base = dict.fromkeys(TAGGED_LOG.names)
    return {**base, "seq": seq, "side": side, "symbol_pair": symbol, "deleted": False, **values}


def config(seq, at, delta, symbol="A", ident=1, deleted=False):
    delta = None if delta is None else Decimal(delta).quantize(Decimal("0.000001"))
    return row(
        seq, "C", symbol, id=ident, delta_percent=delta, config_event_at=at, deleted=deleted
    )


def tick(seq, price, symbol="A", deleted=False):
    price = None if price is None else Decimal(price).quantize(Decimal("0.00000001"))
    return row(seq, "P", symbol, price=price, price_at=seq * 10, deleted=deleted)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in TAGGED_LOG.names) for r in rows], TAGGED_LOG)


def random_log(seed, size, symbols=6, hot=0.35, tombstones=False):
    """Late, tied and negative revisions, nulls, repeats; one symbol has a third."""
    rng, rows = random.Random(seed), []
    for seq in range(size):
        symbol = "HOT" if rng.random() < hot else rng.choice([f"S{i}" for i in range(symbols)])
        if rng.random() < 0.03:
            symbol = None
        kind = rng.random()
        if kind < 0.45:
            price = None if rng.random() < 0.1 else rng.choice(["1", "1.5", "2", "3.25"])
            gone = tombstones and rng.random() < 0.1
            rows.append(tick(seq, price, symbol, gone))
        else:
            at = rng.randrange(-3, 12) + (seq // 20)
            delta = None if rng.random() < 0.1 else rng.choice(["1.0", "1.000000", "2", "0.5"])
            rows.append(
                config(seq, at, delta, symbol, rng.randrange(5), deleted=rng.random() < 0.15)
            )
    return rows
