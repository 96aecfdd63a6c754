"""The same results in SQL, written independently of the DataFrame code.

Where the DataFrame side uses running maxima and aggregates, the SQL uses
``lag``, ``last_value`` and window epochs.
"""

from __future__ import annotations

DAY = 86_400_000
MID_JANUARY = 1_705_276_800_000
YEAR_1995 = 788_918_400_000

CONFIG_KINDS = "('signup', 'click', 'error')"

EVENTS = """
ev AS (
  SELECT event_id AS seq, user_id, 'S' || user_id AS symbol_pair, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""


def log_of(name: str = "log", where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT seq, symbol_pair,
         CASE WHEN event_type IN {CONFIG_KINDS} THEN 'C' ELSE 'P' END AS side,
         CASE WHEN event_type IN {CONFIG_KINDS} THEN user_id END AS id,
         CASE WHEN event_type IN {CONFIG_KINDS}
              THEN CAST(k * 0.125 AS DECIMAL(9,6)) END AS delta_percent,
         CASE WHEN event_type IN {CONFIG_KINDS}
              THEN epoch_ms(date_trunc('day', ts)) - (k % 3) * {DAY} END AS config_event_at,
         CASE WHEN event_type NOT IN {CONFIG_KINDS}
              THEN CAST(value AS DECIMAL(24,8)) END AS price,
         CASE WHEN event_type NOT IN {CONFIG_KINDS} THEN (epoch_us(ts) // 1000) END AS price_at,
         event_type = 'error' AS deleted
  FROM ev WHERE {where}
)"""


LOG = log_of()

CONFIG_TABLE = f"""
cfg AS (
  SELECT c_custkey AS id, 'S' || c_custkey AS symbol_pair,
         CAST(CAST(abs(c_acctbal) AS DECIMAL(9,2)) * 0.01 AS DECIMAL(9,6)) AS delta_percent,
         {MID_JANUARY} AS touched
  FROM customer
)"""

ORDER_TICKS = """
ticks AS (
  SELECT 'S' || o_custkey AS symbol_pair, CAST(o_totalprice AS DECIMAL(24,8)) AS price,
         epoch_ms(o_orderdate) AS price_at, o_orderkey AS seq
  FROM orders
)"""

LINE_TICKS = """
lines AS (
  SELECT 'P' || l_partkey AS symbol_pair, CAST(l_extendedprice AS DECIMAL(24,8)) AS price,
         epoch_ms(l_shipdate) AS price_at, l_shipdate, l_orderkey, l_linenumber,
         ((l_shipdate::DATE - DATE '1970-01-01')::BIGINT * 35184372088832 + l_orderkey) * 8
           + l_linenumber AS seq
  FROM lineitem
)"""


def low(price="price", delta="delta_percent"):
    return f"CAST(round({price} - {price} * {delta} * 0.01, 8) AS DECIMAL(38,8))::VARCHAR"


def high(price="price", delta="delta_percent"):
    return f"CAST(round({price} + {price} * {delta} * 0.01, 8) AS DECIMAL(38,8))::VARCHAR"


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DECIMAL(38,8))::VARCHAR AS {n}" for n in names)


def exact_band(price="price", delta="delta_percent") -> str:
    return (
        f"round({price} - {price} * {delta} * 0.01, 8) AS low_price, "
        f"round({price} + {price} * {delta} * 0.01, 8) AS high_price"
    )


def changelog_of(log: str = "log", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}changes``: the changelog of the joined table."""
    p = prefix
    return f"""
{p}ranked AS (
  SELECT *,
    max(CASE WHEN side = 'C'
        THEN CAST(config_event_at AS HUGEINT) * 100000000000000000000 + seq END) OVER w AS best,
    max(CASE WHEN side = 'P' THEN seq END) OVER w AS tick
  FROM {log} WINDOW w AS (PARTITION BY symbol_pair ORDER BY seq)
),
{p}joined AS (
  SELECT r.symbol_pair, r.seq, c.id AS config_id, p.price, c.delta_percent, p.price_at,
         c.config_event_at,
         c.seq IS NOT NULL AND NOT c.deleted AND p.seq IS NOT NULL AS live
  FROM {p}ranked r
  LEFT JOIN (SELECT *, CAST(config_event_at AS HUGEINT) * 100000000000000000000 + seq AS rev
             FROM {log} WHERE side = 'C') c
    ON c.symbol_pair = r.symbol_pair AND c.rev = r.best
  LEFT JOIN (SELECT * FROM {log} WHERE side = 'P') p
    ON p.symbol_pair = r.symbol_pair AND p.seq = r.tick
),
{p}steps AS (
  SELECT *, coalesce(lag(live) OVER (PARTITION BY symbol_pair ORDER BY seq), false) AS was
  FROM {p}joined
),
{p}changes AS (
  SELECT symbol_pair, CASE WHEN live THEN config_id END AS config_id,
         CASE WHEN live THEN price END AS price,
         CASE WHEN live THEN delta_percent END AS delta_percent,
         CASE WHEN live THEN round(price - price * delta_percent * 0.01, 8) END AS low_price,
         CASE WHEN live THEN round(price + price * delta_percent * 0.01, 8) END AS high_price,
         CASE WHEN live THEN price_at END AS price_at,
         CASE WHEN live THEN config_event_at END AS config_event_at,
         CASE WHEN live THEN 'U' ELSE 'D' END AS op, seq
  FROM {p}steps WHERE live OR was
)"""


FULL = ["price", "delta_percent", "low_price", "high_price"]
SHOW_FULL = "symbol_pair, config_id, " + dbl(*FULL) + ", price_at, config_event_at"
SHOW_CHANGES = SHOW_FULL + ", op, seq"

CHANGES = f"WITH {EVENTS}, {LOG}, {changelog_of()}"
LAST_CHANGE = """
last_change AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_pair ORDER BY seq DESC) AS rn
                 FROM changes) WHERE rn = 1
)"""


def fold_of(log: str = "log", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}folded``: every row with the entry around it."""
    p = prefix
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
{p}epochs AS (
  SELECT *,
    CASE WHEN side = 'P' THEN 'tick' WHEN deleted THEN 'drop' ELSE 'config' END AS event,
    coalesce(sum(CASE WHEN side = 'C' AND deleted THEN 1 ELSE 0 END)
      OVER (PARTITION BY symbol_pair ORDER BY seq {before}), 0) AS epoch
  FROM {log}
),
{p}based AS (
  SELECT *,
    first_value(event) OVER (PARTITION BY symbol_pair, epoch ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_event,
    max(CASE WHEN event = 'config' THEN config_event_at END)
      OVER (PARTITION BY symbol_pair, epoch ORDER BY seq {before}) AS prev_at
  FROM {p}epochs
),
{p}judged AS (
  SELECT *,
    CASE event
      WHEN 'config' THEN coalesce(config_event_at >
        CASE WHEN first_event = 'tick' THEN greatest(coalesce(prev_at, 0), 0) ELSE prev_at END,
        true)
      WHEN 'drop' THEN first_event <> 'drop'
      ELSE true END AS accepted
  FROM {p}based
),
{p}valued AS (
  SELECT *,
    last_value(CASE WHEN event = 'tick' THEN price END IGNORE NULLS) OVER w AS old_price,
    last_value(CASE WHEN event = 'config' AND accepted THEN delta_percent END IGNORE NULLS)
      OVER w AS old_delta,
    last_value(CASE WHEN event = 'config' AND accepted THEN id END IGNORE NULLS)
      OVER w AS old_id,
    last_value(CASE WHEN event = 'config' AND accepted THEN config_event_at END IGNORE NULLS)
      OVER w AS old_at
  FROM {p}judged
  WINDOW w AS (PARTITION BY symbol_pair, epoch ORDER BY seq {before})
),
{p}folded AS (
  SELECT symbol_pair, seq, event, accepted, epoch,
    CASE event WHEN 'tick' THEN price IS DISTINCT FROM old_price
      WHEN 'config' THEN accepted AND delta_percent IS DISTINCT FROM old_delta
      ELSE accepted END AS changed,
    old_price, old_delta,
    CASE WHEN event = 'tick' THEN price ELSE old_price END AS new_price,
    CASE WHEN event = 'config' AND accepted THEN delta_percent ELSE old_delta END AS new_delta,
    CASE WHEN event = 'config' AND accepted THEN id ELSE old_id END AS new_id,
    coalesce(CASE WHEN event = 'config' AND accepted THEN config_event_at ELSE old_at END, 0)
      AS new_at
  FROM {p}valued
),
{p}emitted AS (
  SELECT symbol_pair, new_id AS config_id, new_price AS price, new_delta AS delta_percent,
         {exact_band('new_price', 'new_delta')}, new_at AS config_event_at,
         CASE WHEN event = 'drop' THEN 'D' ELSE 'U' END AS op, seq
  FROM {p}folded
  WHERE changed AND new_price IS NOT NULL AND new_delta IS NOT NULL
)"""


FOLD = f"WITH {EVENTS}, {LOG}, {fold_of()}"
SHOW_FOLD = "symbol_pair, config_id, " + dbl(*FULL) + ", config_event_at, op, seq"


def state_of(log: str = "log", prefix: str = "") -> str:
    """CTE ``{prefix}entries``: what is left per symbol, after ``fold_of``."""
    p = prefix
    return f"""
{p}ends AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol_pair ORDER BY seq DESC) AS rn
    FROM {p}folded) WHERE rn = 1 AND event <> 'drop'
),
{p}entries AS (
  SELECT symbol_pair, new_id AS config_id, new_price AS price, new_delta AS delta_percent,
         {exact_band('new_price', 'new_delta')},
         new_price IS NOT NULL AND new_delta IS NOT NULL AS presented,
         false AS deleted, new_at AS config_event_at
  FROM {p}ends
)"""


SHOW_STATE = (
    "symbol_pair, config_id, " + dbl(*FULL) + ", presented, deleted, config_event_at"
)


def scaled8(value: str) -> str:
    """Text of an 8-decimal number in JSON: zero is written 0E-8."""
    return (
        f"CASE WHEN {value} IS NULL THEN 'null' WHEN {value} = 0 THEN '0E-8' "
        f"ELSE CAST({value} AS VARCHAR) END"
    )


FULL_JSON = (
    """'{"symbolPair":"' || symbol_pair || '","configId":' || config_id || ',"price":' || """
    + scaled8("price")
    + """ || ',"deltaPercent":' || CAST(delta_percent AS VARCHAR) || ',"lowPrice":' || """
    + scaled8("CAST(low_price AS DECIMAL(28,8))")
    + """ || ',"highPrice":' || """
    + scaled8("CAST(high_price AS DECIMAL(28,8))")
    + """ || ',"priceAt":' || price_at || ',"configEventAt":' || config_event_at || '}'"""
)

FOLD_JSON = (
    """'{"presented":true,"deleted":false,"id":' || config_id || ',"symbolPair":"' || symbol_pair"""
    + """ || '","price":' || """
    + scaled8("price")
    + """ || ',"deltaPercent":' || CAST(delta_percent AS VARCHAR) || ',"lowPrice":' || """
    + scaled8("CAST(low_price AS DECIMAL(28,8))")
    + """ || ',"highPrice":' || """
    + scaled8("CAST(high_price AS DECIMAL(28,8))")
    + """ || ',"configEventAt":' || config_event_at || '}'"""
)

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
KIND = (
    "CASE event_type WHEN 'signup' THEN 'PriceConfigCreated' WHEN 'click' THEN "
    "'PriceConfigUpdated' WHEN 'error' THEN 'PriceConfigDeleted' END"
)
REVISION = f"epoch_ms(date_trunc('day', ts)) - (k % 3) * {DAY}"


def body(symbol: str) -> str:
    return (
        """'{"id":' || user_id || ',"symbolPair":' || """
        + symbol
        + """ || ',"deltaPercent":' || CAST(CAST(k * 0.125 AS DECIMAL(9,6)) AS VARCHAR) || """
        + f"""',"updatedAt":"' || strftime(make_timestamp(({REVISION}) * 1000), {ISO}) || '"}}'"""
    )


SYMBOL = """'"' || symbol_pair || '"'"""

# Which rule damages a message, first match first.
CDC = f"""
cdc AS (
  SELECT *, {KIND} AS kind,
    CASE WHEN k % 31 = 0 THEN 'null' WHEN k % 29 = 0 THEN 'symbol' WHEN k % 23 = 0 THEN 'type'
         WHEN k % 19 = 0 THEN 'header' WHEN k % 17 = 0 THEN 'text' WHEN k % 13 = 0 THEN 'wrap'
         WHEN k % 11 = 0 THEN 'twice' ELSE 'fine' END AS rule
  FROM ev WHERE event_type IN {CONFIG_KINDS}
),
msg AS (
  SELECT *,
    CASE rule WHEN 'null' THEN NULL WHEN 'symbol' THEN {body("'null'")}
      WHEN 'text' THEN 'not-json' WHEN 'wrap' THEN '{{"payload":' || {body(SYMBOL)} || '}}'
      ELSE {body(SYMBOL)} END AS message,
    CASE WHEN rule = 'header' THEN NULL
      WHEN k % 23 = 0 AND rule IN ('null', 'symbol', 'type') THEN 'PriceConfigRenamed'
      ELSE kind END AS header_type
  FROM cdc
)"""

PARSED = f"""
parsed AS (
  SELECT user_id AS id, symbol_pair, CAST(k * 0.125 AS DECIMAL(9,6)) AS delta_percent,
         {REVISION} AS config_event_at, kind = 'PriceConfigDeleted' AS deleted,
         seq * 65536 AS seq
  FROM msg WHERE rule IN ('wrap', 'twice', 'fine')
)"""

CDC_CTES = f"WITH {EVENTS}, {CDC}, {PARSED}"

REJECTS = """SELECT 'PRICE_CONFIG.events' AS topic, 0 AS partition, seq AS "offset",
       CAST(seq AS VARCHAR) AS key, message AS value,
       CASE WHEN rule = 'null' THEN 'tombstone'
         WHEN rule = 'header' THEN 'no event type'
         WHEN header_type = 'PriceConfigRenamed' THEN 'unknown event type'
         WHEN rule = 'text' THEN 'not json' ELSE 'no symbol' END AS reason
FROM msg WHERE rule NOT IN ('wrap', 'twice', 'fine')"""

CONFIG_SHOW = "id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent, config_event_at, deleted, seq"


def _newest(source: str, order: str, key: str = "symbol_pair") -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) "
        f"AS rn FROM {source}) WHERE rn = 1)"
    )


LINE_SNAPSHOT = f"""
WITH {LINE_TICKS},
last_line AS {_newest('lines', 'l_shipdate DESC, l_orderkey DESC, l_linenumber DESC')},
full_rows AS (
  SELECT l.symbol_pair, p.p_partkey AS config_id, l.price,
         CAST(p.p_size AS DECIMAL(9,6)) AS delta_percent, l.price_at, 0::BIGINT AS config_event_at
  FROM last_line l JOIN part p ON l.symbol_pair = 'P' || p.p_partkey
),
full_table AS (SELECT *, {exact_band()} FROM full_rows)"""

LINE_LOG = f"""
line_log AS (
  SELECT symbol_pair, seq, 'P' AS side, NULL::BIGINT AS id, NULL::DECIMAL(9,6) AS delta_percent,
         NULL::BIGINT AS config_event_at, price, price_at, false AS deleted FROM lines
  UNION ALL
  SELECT 'P' || p_partkey, -1, 'C', p_partkey, CAST(p_size AS DECIMAL(9,6)), 0, NULL, NULL, false
  FROM part
)"""

BATCHED = """
numbered AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 500 AS batch FROM changes)"""

PUSH = (
    CHANGES
    + ","
    + BATCHED
    + f""",
turns AS (
  SELECT *, last_value(op) OVER (PARTITION BY batch, symbol_pair ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_op,
         max(seq) OVER (PARTITION BY batch, symbol_pair) AS last_seq
  FROM numbered
),
flips AS (
  SELECT batch, symbol_pair, max(seq) AS flipped FROM turns WHERE op <> final_op GROUP BY ALL
),
starts AS (
  SELECT t.batch, t.symbol_pair, min(t.seq) AS first_seq FROM turns t
  LEFT JOIN flips f USING (batch, symbol_pair)
  WHERE f.flipped IS NULL OR t.seq > f.flipped GROUP BY ALL
),
items AS (
  SELECT t.batch, t.final_op, s.first_seq,
    CASE WHEN t.op = 'D' THEN '{{"symbolPair":"' || t.symbol_pair || '","deleted":true}}'
         ELSE {FULL_JSON.replace('symbol_pair', 't.symbol_pair')} END AS item
  FROM turns t JOIN starts s USING (batch, symbol_pair) WHERE t.seq = t.last_seq
),
payloads AS (
  SELECT batch, 'full-config-stream' AS channel,
         count(*) FILTER (final_op = 'U') AS upserts, count(*) FILTER (final_op = 'D') AS deletions,
         '[' || string_agg(item, ',' ORDER BY CASE final_op WHEN 'U' THEN 0 ELSE 1 END, first_seq)
           || ']' AS payload
  FROM items GROUP BY batch
)"""
)


def _grouped(digits: str, places: int) -> str:
    """Text of a rounded non-negative decimal with thousands separators."""
    return (
        f"format('{{:,}}', CAST(floor({digits}) AS BIGINT)) || '.' || "
        f"lpad(CAST(CAST(({digits} - floor({digits})) * {10**places} AS BIGINT) AS VARCHAR), "
        f"{places}, '0')"
    )


REQUESTS = """
req AS (
  SELECT seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create'
              WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN user_id END AS id,
    CASE WHEN event_type = 'purchase' AND k % 4 = 2 THEN rpad(symbol_pair, 40, 'X')
         WHEN event_type = 'view' AND k % 2 = 0 THEN 'R' || (user_id + k % 5)
         WHEN event_type <> 'error' THEN symbol_pair END AS symbol_pair,
    CASE WHEN event_type = 'purchase' THEN
           CASE k % 4 WHEN 0 THEN -CAST(k * 0.125 AS DECIMAL(30,10)) - 1
             WHEN 1 THEN CAST(k * 0.125 AS DECIMAL(30,10)) + 1000
             WHEN 2 THEN NULL
             ELSE CAST(k * 0.125 AS DECIMAL(30,10)) + 0.0000001 END
         WHEN event_type <> 'error' THEN CAST(k * 0.125 AS DECIMAL(30,10)) END AS delta_percent
  FROM ev
)"""


# The requests one after the other: a list folded with the table as accumulator.
# A symbol maps to its owner (-1: free), an id to its symbol ('': removed).
SEQUENTIAL = f"""
checked AS (
  SELECT *, op <> 'delete' AND (symbol_pair IS NULL OR length(symbol_pair) > 32
    OR delta_percent IS NULL OR delta_percent < 0 OR delta_percent >= 1000
    OR round(delta_percent, 6) <> delta_percent) AS bad
  FROM req
),
named AS (
  SELECT * FROM cfg WHERE id IN (SELECT id FROM req)
    OR symbol_pair IN (SELECT symbol_pair FROM req)
),
script AS (
  SELECT [{{'seq': -1::BIGINT, 'op': '', 'id': 0::BIGINT, 'sym': '', 'bad': false,
           'owner': (SELECT map_from_entries(list((symbol_pair, id))) FROM named),
           'home': (SELECT map_from_entries(list((id, symbol_pair))) FROM named),
           'last': (SELECT max(id) FROM cfg)::BIGINT, 'done': []::INTEGER[]}}]
    || list({{'seq': seq, 'op': op, 'id': id, 'sym': symbol_pair, 'bad': bad,
            'owner': MAP {{}}::MAP(VARCHAR, BIGINT), 'home': MAP {{}}::MAP(BIGINT, VARCHAR),
            'last': 0::BIGINT, 'done': []::INTEGER[]}} ORDER BY seq) AS steps
  FROM checked
),
played AS (
  SELECT list_reduce(steps, lambda acc, x: list_transform([
      CASE WHEN x.bad THEN 400
        WHEN x.op = 'create' THEN
          CASE WHEN coalesce(acc.owner[x.sym], -1) = -1 THEN 201 ELSE 409 END
        WHEN coalesce(acc.home[x.id], '') = '' THEN 404
        WHEN x.op = 'delete' THEN 204
        WHEN coalesce(acc.owner[x.sym], -1) IN (-1, x.id) THEN 200
        ELSE 409 END], lambda st: {{
      'seq': x.seq, 'op': x.op, 'id': x.id, 'sym': x.sym, 'bad': x.bad,
      'owner': CASE st
        WHEN 201 THEN map_concat(acc.owner, MAP {{x.sym: acc.last + 1}})
        WHEN 200 THEN map_concat(acc.owner, MAP {{acc.home[x.id]: -1::BIGINT}}, MAP {{x.sym: x.id}})
        WHEN 204 THEN map_concat(acc.owner, MAP {{acc.home[x.id]: -1::BIGINT}})
        ELSE acc.owner END,
      'home': CASE st
        WHEN 201 THEN map_concat(acc.home, MAP {{acc.last + 1: x.sym}})
        WHEN 200 THEN map_concat(acc.home, MAP {{x.id: x.sym}})
        WHEN 204 THEN map_concat(acc.home, MAP {{x.id: ''}})
        ELSE acc.home END,
      'last': CASE st WHEN 201 THEN acc.last + 1 ELSE acc.last END,
      'done': list_append(acc.done, st::INTEGER)}})[1]).done AS done
  FROM script
),
statuses AS (
  SELECT c.*, p.status FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM checked) c
  JOIN (SELECT unnest(done) AS status, generate_subscripts(done, 1) AS n FROM played) p USING (n)
),
outcome AS (
  SELECT seq, op, symbol_pair, CAST(delta_percent AS DECIMAL(30,6)) AS delta_percent, status,
         {MID_JANUARY} + seq * 1000 AS touched,
         CASE WHEN status = 201 THEN (SELECT max(id) FROM cfg)
           + count(*) FILTER (status = 201) OVER (ORDER BY seq) ELSE id END AS id
  FROM statuses
),
accepted AS (
  SELECT o.seq, o.op, o.id,
    CASE WHEN op <> 'delete' THEN o.symbol_pair
      ELSE coalesce(last_value(CASE WHEN op <> 'delete' THEN o.symbol_pair END IGNORE NULLS) OVER w,
                    cfg.symbol_pair) END AS symbol_pair,
    CASE WHEN op <> 'delete' THEN o.delta_percent
      ELSE coalesce(last_value(CASE WHEN op <> 'delete' THEN o.delta_percent END IGNORE NULLS)
                    OVER w, cfg.delta_percent) END AS delta_percent,
    CASE WHEN op <> 'delete' THEN o.touched
      ELSE coalesce(last_value(CASE WHEN op <> 'delete' THEN o.touched END IGNORE NULLS) OVER w,
                    cfg.touched) END AS touched
  FROM outcome o LEFT JOIN cfg ON o.id = cfg.id WHERE status < 300
  WINDOW w AS (PARTITION BY o.id ORDER BY seq)
)"""

MUTATIONS = f"WITH {EVENTS}, {REQUESTS}, {CONFIG_TABLE}, {SEQUENTIAL}"

# The same log where creates take symbols of their own and ids above the table's are named.
FRESH_REQUESTS = f"""
{REQUESTS.replace("req AS", "plain_req AS")}, {CONFIG_TABLE.strip()},
req AS (
  SELECT seq, op, CASE WHEN op <> 'create' AND seq % 3 = 0
                    THEN (SELECT max(id) FROM cfg) + 1 + seq // 16 ELSE id END AS id,
    CASE WHEN op <> 'delete' AND length(symbol_pair) <= 32 AND seq % 2 = 0
      THEN 'N' || (seq % (SELECT max(id) FROM cfg)) ELSE symbol_pair END AS symbol_pair,
    delta_percent
  FROM plain_req
)"""
FRESH_MUTATIONS = f"WITH {EVENTS}, {FRESH_REQUESTS}, {SEQUENTIAL}"


def _ttl(expiry: str, as_of: int) -> str:
    return (
        CHANGES
        + ","
        + LAST_CHANGE
        + f""",
stamped AS (
  SELECT *, greatest(price_at, config_event_at) AS written FROM last_change WHERE op = 'U'
),
expiring AS (SELECT *, {expiry} AS expires_at FROM stamped)
SELECT {SHOW_FULL}, expires_at FROM expiring WHERE expires_at > {as_of}"""
    )


def _seeded(seed: str, log: str) -> str:
    """CTE ``seeded_log``: restored entries before the rows of ``log``."""
    return f"""
seeded_log AS (
  SELECT symbol_pair, -2 AS seq, 'C' AS side, config_id AS id, delta_percent, config_event_at,
         NULL::DECIMAL(24,8) AS price, false AS deleted FROM {seed}
  UNION ALL
  SELECT symbol_pair, -1, 'P', NULL, NULL, NULL, price, false FROM {seed} WHERE price IS NOT NULL
  UNION ALL
  SELECT symbol_pair, seq, side, id, delta_percent, config_event_at, price, deleted FROM {log}
)"""


def _renewed() -> str:
    start, ttl, every, stop = 1_704_067_200_000, 3 * DAY, DAY // 2, MID_JANUARY + 8 * DAY
    first = f"{start} + (greatest((written - {start}) // {every}, 0) + 1) * {every}"
    last = start + (stop - start) // every * every
    return (
        f"CASE WHEN ({first}) < written + {ttl} AND ({first}) <= {stop} "
        f"THEN {last + ttl} ELSE written + {ttl} END"
    )


def enriched(ticks: str, table: str) -> str:
    return f"""SELECT t.symbol_pair, CAST(t.price AS DECIMAL(38,8))::VARCHAR AS price, t.price_at, t.seq,
                   c.config_id, CAST(c.price AS DECIMAL(38,8))::VARCHAR AS last_price,
                   CAST(c.low_price AS DECIMAL(38,8))::VARCHAR AS low_price,
                   CAST(c.high_price AS DECIMAL(38,8))::VARCHAR AS high_price
            FROM {ticks} t LEFT JOIN {table} c
              ON t.symbol_pair = c.symbol_pair AND c.op = 'U'"""


def oracle() -> dict[str, str]:
    changes = f"{CHANGES} SELECT {SHOW_CHANGES} FROM changes"
    fold = f"{FOLD} SELECT {SHOW_FOLD} FROM emitted"
    sql = {
        "cdc_scan": f"""WITH {EVENTS}, {CDC}
            SELECT 'PRICE_CONFIG.events' AS topic, 0 AS partition, seq AS "offset",
                   (epoch_us(ts) // 1000) AS "at", CAST(seq AS VARCHAR) AS key, message AS value,
                   CASE rule WHEN 'header' THEN 1 WHEN 'twice' THEN 3 ELSE 2 END AS headers
            FROM msg""",
        "snapshot_scan": f"""WITH {CONFIG_TABLE}
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   touched AS config_event_at, false AS deleted, CAST(-1 AS BIGINT) AS seq FROM cfg""",
        "price_table": f"""WITH {ORDER_TICKS}
            SELECT symbol_pair, CAST(price AS DECIMAL(38,8))::VARCHAR AS price, price_at, seq
            FROM {_newest('ticks', 'seq DESC')}""",
        "changelog_scan": changes,
        "global_scan": f"""{CHANGES}, {LAST_CHANGE}
            SELECT {SHOW_FULL} FROM last_change WHERE op = 'U' ORDER BY symbol_pair""",
        "config_list": f"""WITH {CONFIG_TABLE}
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   touched AS updated_at FROM cfg""",
        "config_lookup": f"""WITH {CONFIG_TABLE},
            keys AS (SELECT DISTINCT 'S' || (o_custkey * 2) AS symbol_pair FROM orders)
            SELECT keys.symbol_pair, id, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   id IS NOT NULL AS found
            FROM keys LEFT JOIN cfg ON keys.symbol_pair = cfg.symbol_pair""",
        "outbox_incremental": f"""WITH {EVENTS}, {CDC}
            SELECT CASE WHEN seq <= (SELECT max(seq) // 2 FROM cdc) THEN 1 ELSE 2 END AS increment,
                   seq AS id, 'e-' || seq AS event_id, kind AS type,
                   CAST(user_id AS VARCHAR) AS aggregateid FROM cdc""",
        "projection_scan": _ttl(f"written + {2 * DAY}", MID_JANUARY + 14 * DAY),
        "bad_records": f"""WITH {EVENTS}, {CDC}
            SELECT seq AS "offset", CAST(seq AS VARCHAR) AS key, message AS value
            FROM msg WHERE message = 'not-json'""",
        "changelog_sink": f"""{CHANGES}
            SELECT 'stream.full-config.events' AS topic, symbol_pair AS key,
                   CASE WHEN op = 'U' THEN {FULL_JSON} END AS value, seq FROM changes""",
        "compact": f"{LINE_SNAPSHOT} SELECT {SHOW_FULL} FROM full_table",
        "publish_snapshot": f"""WITH {CONFIG_TABLE}
            SELECT 'stream.PRICE_CONFIG.snapshot' AS topic, symbol_pair AS key,
                   '{{"id":' || id || ',"symbolPair":"' || symbol_pair || '","deltaPercent":' ||
                   CAST(delta_percent AS VARCHAR) || ',"configEventAt":' || touched ||
                   ',"deleted":false}}' AS value, CAST(-1 AS BIGINT) AS seq FROM cfg""",
        "publish_prices": f"""WITH {ORDER_TICKS}
            SELECT 'stream.MARKET_PRICE.events' AS topic, symbol_pair AS key,
                   '{{"symbolPair":"' || symbol_pair || '","price":' || {scaled8('price')} ||
                   ',"priceAt":1704067200000}}' AS value, seq FROM ticks""",
        "project_collapse": f"""{CHANGES}, {BATCHED}
            SELECT {SHOW_CHANGES}, batch
            FROM {_newest('numbered', 'seq DESC', 'batch, symbol_pair')}""",
        "project_fold_batches": f"""{FOLD},
            numbered AS (
              SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 100 AS batch FROM emitted),
            grouped AS (
              SELECT *, bool_or(op = 'D') OVER (PARTITION BY symbol_pair, batch) AS removed,
                     row_number() OVER (PARTITION BY symbol_pair ORDER BY seq DESC) AS rn
              FROM numbered)
            SELECT symbol_pair, config_id, {dbl(*FULL)}, config_event_at, seq
            FROM grouped WHERE rn = 1 AND NOT removed""",
        "push_payload": f"{PUSH} SELECT * FROM payloads",
        "push_payload_fold": f"""{FOLD},
            shown AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 100 AS batch
                      FROM emitted WHERE op = 'U')
            SELECT batch, 'price-stream' AS channel, count(*) AS upserts,
                   '[' || string_agg({FOLD_JSON}, ',' ORDER BY seq) || ']' AS payload
            FROM shown GROUP BY batch""",
        "push_envelope": f"""{PUSH}
            SELECT batch, channel,
                   '{{"method":"publish","params":{{"channel":"' || channel || '","data":' ||
                   payload || '}}}}' AS request, sha256(payload) AS data FROM payloads""",
        "outbox_route": f"""WITH {EVENTS}, {CDC}
            SELECT 'PRICE_CONFIG.events' AS topic, CAST(user_id AS VARCHAR) AS key,
                   {body(SYMBOL)} AS value, seq AS "offset", 'e-' || seq AS id_header,
                   kind AS type_header FROM cdc""",
        "cdc_parse": f"{CDC_CTES} SELECT {CONFIG_SHOW} FROM parsed",
        "cdc_header": f"""{CDC_CTES}
            SELECT seq AS "offset", header_type AS event_type, 'e-' || seq AS event_id FROM msg""",
        "cdc_type_map": f"""{CDC_CTES}
            SELECT seq AS "offset", header_type AS event_type,
                   header_type = 'PriceConfigDeleted' AS deleted
            FROM msg WHERE header_type <> 'PriceConfigRenamed'""",
        "cdc_unwrap": f"""{CDC_CTES}
            SELECT seq AS "offset", CAST(user_id AS VARCHAR) AS id,
              CASE WHEN rule <> 'symbol' THEN symbol_pair END AS symbol_pair,
              CAST(k * 0.125 AS DOUBLE) AS delta_percent,
              strftime(make_timestamp(({REVISION}) * 1000), {ISO}) AS updated_at
            FROM msg WHERE rule NOT IN ('null', 'text')""",
        "cdc_fields": f"""{CDC_CTES}
            SELECT seq AS "offset",
              CASE WHEN rule NOT IN ('null', 'text') THEN user_id END AS id,
              CASE WHEN rule NOT IN ('null', 'text', 'symbol') THEN symbol_pair END AS symbol_pair,
              CASE WHEN rule NOT IN ('null', 'text') THEN CAST(k * 0.125 AS DECIMAL(38,8))::VARCHAR END
                AS delta_percent,
              CASE WHEN rule NOT IN ('null', 'text') THEN {REVISION} ELSE 0 END AS config_event_at
            FROM msg""",
        "cdc_rejects": f"{CDC_CTES} {REJECTS}",
        "rekey": f"{CDC_CTES} SELECT symbol_pair AS key, id, seq FROM parsed",
        "latest_config": f"""WITH {EVENTS}, {LOG}
            SELECT {CONFIG_SHOW}
            FROM {_newest("(SELECT * FROM log WHERE side = 'C')", 'config_event_at DESC, seq DESC')}""",
        "active_configs": f"""WITH {EVENTS}, {LOG}
            SELECT {CONFIG_SHOW}
            FROM {_newest("(SELECT * FROM log WHERE side = 'C')", 'config_event_at DESC, seq DESC')}
            WHERE NOT deleted""",
        "latest_price": f"""WITH {LINE_TICKS}
            SELECT symbol_pair, CAST(price AS DECIMAL(38,8))::VARCHAR AS price, price_at, seq
            FROM {_newest('lines', 'l_shipdate DESC, l_orderkey DESC, l_linenumber DESC')}""",
        "merge_config_streams": f"""{CDC_CTES}, {CONFIG_TABLE},
            merged AS (
              SELECT * FROM parsed UNION ALL
              SELECT id, symbol_pair, delta_percent, touched, false, -1 FROM cfg)
            SELECT {CONFIG_SHOW} FROM {_newest('merged', 'config_event_at DESC, seq DESC')}""",
        "collapse": f"{CHANGES}, {LAST_CHANGE} SELECT {SHOW_CHANGES} FROM last_change",
        "batch_metrics": f"""{CHANGES}, {BATCHED},
            ends AS {_newest('numbered', 'seq DESC', 'batch, symbol_pair')}
            SELECT batch, (SELECT count(*) FROM numbered n WHERE n.batch = ends.batch) AS records,
                   count(*) AS keys, count(*) FILTER (op = 'U') AS upserts,
                   count(*) FILTER (op = 'D') AS deletions
            FROM ends GROUP BY batch""",
        "full_config_snapshot": f"{LINE_SNAPSHOT} SELECT {SHOW_FULL} FROM full_table",
        "full_config_changelog": changes,
        "full_config_line_changelog": f"""WITH {LINE_TICKS}
            SELECT l.symbol_pair, p.p_partkey AS config_id, CAST(price AS DECIMAL(38,8))::VARCHAR AS price,
                   CAST(p.p_size AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   {low('price', 'CAST(p.p_size AS DECIMAL(9,6))')} AS low_price,
                   {high('price', 'CAST(p.p_size AS DECIMAL(9,6))')} AS high_price,
                   price_at, CAST(0 AS BIGINT) AS config_event_at, 'U' AS op, seq
            FROM lines l JOIN part p ON l.symbol_pair = 'P' || p.p_partkey""",
        "enrich_with_full_config": f"""{CHANGES}, {LAST_CHANGE}, {ORDER_TICKS}
            {enriched('ticks', 'last_change')}""",
        "fold_accept": f"{FOLD} SELECT symbol_pair, seq, event, accepted FROM folded",
        "fold_changes": f"""{FOLD}
            SELECT symbol_pair, seq, event, {dbl('old_price', 'old_delta', 'new_price', 'new_delta')}
            FROM folded WHERE changed AND event <> 'drop'""",
        "fold_changelog": fold,
        "fold_state": f"{FOLD}, {state_of()} SELECT {SHOW_STATE} FROM entries",
        "fold_snapshot": f"{FOLD}, {state_of()} SELECT {SHOW_STATE} FROM entries WHERE presented",
        "fold_restore": f"""WITH {EVENTS},
            {log_of('early', f"(epoch_us(ts) // 1000) < {MID_JANUARY}")},
            {log_of('late', f"(epoch_us(ts) // 1000) >= {MID_JANUARY}")},
            {fold_of('early', 'a_')}, {state_of('early', 'a_')},
            cached AS (SELECT * FROM a_entries WHERE presented),
            {_seeded('cached', 'late')}, {fold_of('seeded_log')}
            SELECT {SHOW_FOLD} FROM emitted WHERE seq >= 0""",
        "fold_rebuild": f"""WITH {EVENTS}, {LOG}, {CONFIG_TABLE},
            rows_before AS (SELECT symbol_pair, id AS config_id, NULL::DECIMAL(24,8) AS price,
                                   delta_percent, touched AS config_event_at FROM cfg),
            {_seeded('rows_before', 'log')}, {fold_of('seeded_log')}
            SELECT {SHOW_FOLD} FROM emitted WHERE seq >= 0""",
        "fold_reconcile": f"""WITH {EVENTS}, {LOG}, {CONFIG_TABLE},
            longer AS (
              SELECT symbol_pair, seq, side, id, delta_percent, config_event_at, price, deleted
              FROM log UNION ALL
              SELECT symbol_pair, id + 1 + (SELECT max(seq) FROM log), 'C', id, delta_percent, touched,
                     NULL, false FROM cfg),
            {fold_of('longer')} SELECT {SHOW_FOLD} FROM emitted""",
        "tick_direction": f"""WITH {ORDER_TICKS},
            steps AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol_pair ORDER BY seq)
                      AS move FROM ticks)
            SELECT symbol_pair, CAST(price AS DECIMAL(38,8))::VARCHAR AS price, price_at, seq,
                   CASE sign(move) WHEN 1 THEN 'up' WHEN -1 THEN 'down' END AS direction
            FROM steps""",
        "page": f"""{LINE_SNAPSHOT}
            SELECT {SHOW_FULL} FROM (SELECT * FROM full_table
              ORDER BY price DESC NULLS LAST, symbol_pair OFFSET 40 LIMIT 20)""",
        "page_after": f"""{LINE_SNAPSHOT}
            SELECT {SHOW_FULL} FROM (SELECT * FROM full_table
              ORDER BY price DESC NULLS LAST, symbol_pair OFFSET 40 LIMIT 20)""",
        "page_indexed": f"""{LINE_SNAPSHOT},
            ranked AS (SELECT *, CAST((row_number() OVER (
                ORDER BY price DESC NULLS LAST, symbol_pair) - 1) // 20 AS INTEGER) AS number,
              CAST((count(*) OVER () - 1) // 20 AS INTEGER) AS last_number FROM full_table)
            SELECT {SHOW_FULL}, number FROM ranked
            WHERE number IN (2, last_number // 2, last_number)""",
        "page_meta": f"""{LINE_SNAPSHOT}
            SELECT 2 AS page, 20 AS size, count(*) AS total_elements,
                   CAST(ceil(count(*) / 20.0) AS INTEGER) AS total_pages,
                   false AS first, 3 >= ceil(count(*) / 20.0) AS last FROM full_table""",
        "projection_ttl": _ttl(f"written + {2 * DAY}", MID_JANUARY + 14 * DAY),
        "projection_ttl_renewed": _ttl(_renewed(), MID_JANUARY + 10 * DAY),
        "scale_values": """SELECT l_orderkey, l_partkey, l_linenumber,
            CAST(CAST(round(l_extendedprice * (1 - l_discount) / 7, 4) AS DECIMAL(24,8)) AS DECIMAL(38,8))::VARCHAR
              AS price,
            CASE WHEN l_partkey / 4.0 < 1000 THEN
              CAST(CAST(l_partkey / 4.0 AS DECIMAL(20,6)) AS DECIMAL(38,8))::VARCHAR END AS delta_percent
            FROM lineitem""",
        "band": _band_sql(),
        "format_price": f"""WITH v AS (
              SELECT l_orderkey, l_partkey, l_linenumber,
                CAST(CAST(l_extendedprice AS DECIMAL(24,8)) * CAST(l_discount AS DECIMAL(4,2))
                  * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(24,8)) AS v FROM lineitem),
            r AS (SELECT *, round(v, 2) AS r2, round(v, 4) AS r4, round(v, 8) AS r8 FROM v)
            SELECT l_orderkey, l_partkey, l_linenumber,
              CASE WHEN v >= 1000 THEN {_grouped('r2', 2)} WHEN v >= 1 THEN {_grouped('r4', 4)}
                ELSE {_grouped('r8', 8)} END AS shown FROM r""",
        "base_symbol": """SELECT p_partkey,
            substr(split_part(replace(p_name, ' ', '-'), '-', 1), 1, 4) AS base FROM part""",
        "normalise_symbol": "SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS symbol FROM part",
        "format_time": """SELECT event_id, CASE WHEN event_type = 'error' THEN '—'
            ELSE strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') END AS shown FROM events""",
        "validation_errors": f"""WITH {EVENTS}, {REQUESTS}, checked AS (
              SELECT seq, 'symbolPair' AS field, CASE
                WHEN symbol_pair IS NULL OR trim(symbol_pair) = '' THEN 'must not be blank'
                WHEN length(symbol_pair) > 32 THEN 'size must be between 0 and 32' END AS message
              FROM req WHERE op <> 'delete'
              UNION ALL
              SELECT seq, 'deltaPercent', CASE
                WHEN delta_percent IS NULL THEN 'must not be null'
                WHEN delta_percent < 0 THEN 'must be greater than or equal to 0'
                WHEN abs(delta_percent) >= 1000 OR round(delta_percent, 6) <> delta_percent
                THEN 'numeric value out of bounds (<3 digits>.<6 digits> expected)' END
              FROM req WHERE op <> 'delete')
            SELECT * FROM checked WHERE message IS NOT NULL""",
        "mutation_results": f"""{MUTATIONS}
            SELECT seq, op, id, status, CASE status WHEN 400 THEN 'VALIDATION_FAILED'
              WHEN 404 THEN 'PRICE_CONFIG_NOT_FOUND' WHEN 409 THEN 'DUPLICATE_SYMBOL_PAIR'
              END AS error_code FROM outcome""",
        "mutation_table": f"""{MUTATIONS}
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   touched AS updated_at
            FROM {_newest('accepted', 'seq DESC', 'id')} WHERE op <> 'delete'
            UNION ALL
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR, touched FROM cfg
            WHERE id NOT IN (SELECT id FROM accepted)""",
        "mutation_fresh_results": f"""{FRESH_MUTATIONS}
            SELECT seq, op, id, status, CASE status WHEN 400 THEN 'VALIDATION_FAILED'
              WHEN 404 THEN 'PRICE_CONFIG_NOT_FOUND' WHEN 409 THEN 'DUPLICATE_SYMBOL_PAIR'
              END AS error_code FROM outcome""",
        "mutation_fresh_table": f"""{FRESH_MUTATIONS}
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   touched AS updated_at
            FROM {_newest('accepted', 'seq DESC', 'id')} WHERE op <> 'delete'
            UNION ALL
            SELECT id, symbol_pair, CAST(delta_percent AS DECIMAL(38,8))::VARCHAR, touched FROM cfg
            WHERE id NOT IN (SELECT id FROM accepted)""",
        "outbox_rows": f"""{MUTATIONS}
            SELECT row_number() OVER (ORDER BY seq) AS id, 'e-' || seq AS event_id,
                   'PRICE_CONFIG' AS aggregatetype, CAST(id AS VARCHAR) AS aggregateid,
                   CASE op WHEN 'create' THEN 'PriceConfigCreated' WHEN 'update' THEN
                     'PriceConfigUpdated' ELSE 'PriceConfigDeleted' END AS type,
                   '{{"id":' || id || ',"symbolPair":"' || symbol_pair || '","deltaPercent":' ||
                   CAST(CAST(delta_percent AS DECIMAL(9,6)) AS VARCHAR) || ',"updatedAt":"' ||
                   strftime(make_timestamp(touched * 1000), {ISO}) || '"}}' AS payload
            FROM accepted""",
        "stream_full_config": f"""{CHANGES}, {LAST_CHANGE}
            SELECT {SHOW_FULL}, last_seen AS seq FROM last_change
            JOIN (SELECT symbol_pair AS s, max(seq) AS last_seen FROM log GROUP BY 1)
              ON s = symbol_pair
            WHERE op = 'U'""",
        "stream_changelog": changes,
        "full_config_changelog_split": changes,
        "fold_changelog_split": fold,
        "stream_cdc_to_table": f"""{CDC_CTES}, {ORDER_TICKS},
            c AS {_newest('parsed', 'config_event_at DESC, seq DESC')},
            p AS {_newest('ticks', 'seq DESC')}
            SELECT c.symbol_pair, c.id AS config_id, CAST(p.price AS DECIMAL(38,8))::VARCHAR AS price,
                   CAST(c.delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   {low('p.price', 'c.delta_percent')} AS low_price,
                   {high('p.price', 'c.delta_percent')} AS high_price,
                   p.price_at, c.config_event_at
            FROM c JOIN p ON c.symbol_pair = p.symbol_pair WHERE NOT c.deleted""",
        "stream_fold_changelog": fold,
        "stream_cdc_quarantine": f"""{CDC_CTES}
            SELECT {CONFIG_SHOW}, NULL AS topic, NULL AS partition, NULL AS "offset", NULL AS key,
                   NULL AS value, NULL AS reason FROM parsed
            UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, * FROM ({REJECTS})""",
        "stream_enrich": f"""{CHANGES}, {LAST_CHANGE}, {ORDER_TICKS},
            {log_of('early', f"(epoch_us(ts) // 1000) < {MID_JANUARY}")},
            {changelog_of('early', 'a_')},
            a_last AS {_newest('a_changes', 'seq DESC')}
            {enriched(f"(SELECT * FROM ticks WHERE price_at < {YEAR_1995})", 'a_last')}
            UNION ALL
            {enriched(f"(SELECT * FROM ticks WHERE price_at >= {YEAR_1995})", 'last_change')}""",
        "bootstrap_equivalence": f"""WITH {EVENTS}, {LOG}, {CONFIG_TABLE}, {ORDER_TICKS},
            configs AS (
              SELECT id, symbol_pair, delta_percent, config_event_at, deleted, seq FROM log
              WHERE side = 'C' UNION ALL
              SELECT id, symbol_pair, delta_percent, touched, false, -1 FROM cfg),
            prices AS (
              SELECT symbol_pair, price, price_at, seq FROM log WHERE side = 'P' UNION ALL
              SELECT symbol_pair, price, price_at, seq - 1099511627776 FROM ticks),
            c AS {_newest('configs', 'config_event_at DESC, seq DESC')},
            p AS {_newest('prices', 'seq DESC')}
            SELECT c.symbol_pair, c.id AS config_id, CAST(p.price AS DECIMAL(38,8))::VARCHAR AS price,
                   CAST(c.delta_percent AS DECIMAL(38,8))::VARCHAR AS delta_percent,
                   {low()} AS low_price, {high()} AS high_price, p.price_at, c.config_event_at
            FROM c JOIN p ON c.symbol_pair = p.symbol_pair WHERE NOT c.deleted""",
    }
    return sql


def _band_sql() -> str:
    """16 significant digits, ties to even, by the number of integer digits."""
    cases = " ".join(
        f"WHEN abs(raw) < {10**k} THEN CAST(round_even(raw, {16 - k}) AS DECIMAL(34,16))"
        for k in range(1, 16)
    )
    return f"""WITH v AS (
      SELECT l_orderkey, l_partkey, l_linenumber,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 10007.12345 AS DECIMAL(24,8)) AS price,
        CAST(CAST(l_quantity AS DECIMAL(5,0)) + CAST(l_tax AS DECIMAL(4,2)) * 1.0101
          AS DECIMAL(9,6)) AS delta_percent
      FROM lineitem),
    a AS (SELECT *, CAST(price AS DECIMAL(20,8)) * delta_percent * 0.01 AS raw FROM v),
    b AS (SELECT *, CASE WHEN abs(raw) < 1 THEN CAST(raw AS DECIMAL(34,16)) {cases} END AS amount
          FROM a)
    SELECT l_orderkey, l_partkey, l_linenumber, {dbl('price', 'delta_percent')},
      CAST(round(CAST(price AS DECIMAL(20,8)) - CAST(amount AS DECIMAL(30,16)), 8) AS DECIMAL(38,8))::VARCHAR
        AS low_price,
      CAST(round(CAST(price AS DECIMAL(20,8)) + CAST(amount AS DECIMAL(30,16)), 8) AS DECIMAL(38,8))::VARCHAR
        AS high_price
    FROM b"""
