"""The semantics in plain Python, one record at a time, to compare with."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

SIXTEEN = Context(prec=16, rounding=ROUND_HALF_EVEN)
EXACT = Context(prec=60)


def scaled(value, places):
    return None if value is None else value.quantize(
        Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP, context=EXACT
    )


def band(price, delta):
    price, delta = scaled(price, 8), scaled(delta, 6)
    if price is None or delta is None:
        return None, None
    amount = SIXTEEN.divide(EXACT.multiply(price, delta), Decimal(100))
    return (
        scaled(EXACT.subtract(price, amount), 8),
        scaled(EXACT.add(price, amount), 8),
    )


def join_changelog(log):
    """Emitted (op, symbol, seq, config id, price, delta) per record."""
    configs, prices, out = {}, {}, []
    for row in sorted(log, key=lambda r: r["seq"]):
        key = row["symbol_pair"]
        if key is None:
            continue

        def joined():
            config, price = configs.get(key), prices.get(key)
            alive = config is not None and not config["deleted"] and price is not None
            return (config["id"], price["price"], config["delta_percent"]) if alive else None

        was = joined()
        if row["side"] == "P":
            if row["deleted"]:
                prices.pop(key, None)
            else:
                prices[key] = row
        elif key not in configs or row["config_event_at"] >= configs[key]["config_event_at"]:
            configs[key] = row
        now = joined()
        if now:
            out.append(("U", key, row["seq"], *now))
        elif was:
            out.append(("D", key, row["seq"], None, None, None))
    return out


def fold(log, seed=None):
    """Emitted (op, symbol, seq, config id, price, delta, at), and the entries left."""
    entries, out = {k: dict(v) for k, v in (seed or {}).items()}, []

    def show(op, key, seq, entry):
        if entry["price"] is not None and entry["delta"] is not None:
            out.append((op, key, seq, entry["id"], entry["price"], entry["delta"], entry["at"]))

    for row in sorted(log, key=lambda r: r["seq"]):
        key = row["symbol_pair"]
        if key is None:
            continue
        entry = entries.get(key)
        if row["side"] == "C" and row["deleted"]:
            if entry is not None:
                del entries[key]
                show("D", key, row["seq"], entry)
        elif row["side"] == "P":
            entry = entries.setdefault(key, {"id": None, "price": None, "delta": None, "at": 0})
            old, entry["price"] = entry["price"], row["price"]
            if old != entry["price"]:
                show("U", key, row["seq"], entry)
        else:
            if entry is not None and row["config_event_at"] <= entry["at"]:
                continue
            entry = entries.setdefault(key, {"id": None, "price": None, "delta": None, "at": 0})
            old = entry["delta"]
            entry.update(id=row["id"], at=row["config_event_at"], delta=row["delta_percent"])
            if old != entry["delta"]:
                show("U", key, row["seq"], entry)
    return out, entries


def apply_requests(configs, requests):
    """Statuses by seq, and the table; ``configs`` maps id to (symbol, delta)."""
    table = dict(configs)
    owner = {symbol: row_id for row_id, (symbol, _) in table.items()}
    status, fresh = {}, max(table, default=0)
    for r in sorted(requests, key=lambda r: r["seq"]):
        if r["op"] == "create":
            if r["symbol_pair"] in owner:
                status[r["seq"]] = (409, None)
                continue
            fresh += 1
            table[fresh] = (r["symbol_pair"], r["delta_percent"])
            owner[r["symbol_pair"]] = fresh
            status[r["seq"]] = (201, fresh)
        elif r["id"] not in table:
            status[r["seq"]] = (404, r["id"])
        elif r["op"] == "delete":
            del owner[table.pop(r["id"])[0]]
            status[r["seq"]] = (204, r["id"])
        elif owner.get(r["symbol_pair"], r["id"]) != r["id"]:
            status[r["seq"]] = (409, r["id"])
        else:
            del owner[table[r["id"]][0]]
            table[r["id"]] = (r["symbol_pair"], r["delta_percent"])
            owner[r["symbol_pair"]] = r["id"]
            status[r["seq"]] = (200, r["id"])
    return status, table
