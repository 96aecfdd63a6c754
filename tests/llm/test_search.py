"""Decontamination, URL filters, nearest neighbours, repeated passages, secrets."""

import hashlib
import math
import random
import re
from glob import glob

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandstream.llm import decontaminate, neighbours, secrets, suffixes, urlfilter
from bandstream.session import scratch_path

from .conftest import text_of, words

# --- decontamination ----------------------------------------------------------


def sellers(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
    return min(row)


@given(st.text("abc ", min_size=1, max_size=20), st.text("abcd ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_myers_is_the_edit_distance(item, text):
    want = min(sellers(item, text), len(item))
    hit = decontaminate.myers(decontaminate.masks(item), len(item), text, len(item))
    assert (hit[0] if hit else len(item)) == want


def edited(text, edits, seed):
    draw, out = random.Random(seed), list(text)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice([[], ["q"], [out[at], "z"]])
    return "".join(out)


def test_matches_against_all_alignments(spark, folder):
    items = [(i, " ".join(words(70 + i, 12)).capitalize() + ".") for i in range(8)]
    items += [(50, None), (51, ""), (52, "tiny"), (53, "!!")]
    rows = []
    for n in range(60):
        body = text_of(500 + n, 40)
        if n % 2:
            body += "\n" + edited(items[n % 8][1], n // 6, n).upper() + " " + text_of(900 + n, 20)
        rows.append((n, body, None, None, None))
    rows.append((99, "so Tiny, it is", None, None, None))
    rows.append((98, "tinytiny", None, None, None))
    folder.docs(rows).put("benchmark", spark.createDataFrame(items, "item_id long, text string"))
    got = {
        (r["doc_id"], r["item_id"]): r for r in decontaminate.op1_decontaminate(spark, folder.path).collect()
    }
    want = {}
    for doc, text, *_ in rows:
        for item, body in items:
            plain = decontaminate.plain(body or "")[1:-1]
            if not plain:
                continue
            k = decontaminate.budget(len(plain))
            plain = plain if k else f" {plain} "
            distance = sellers(plain, decontaminate.plain(text))
            if distance <= k:
                want[doc, item] = distance
    assert {key: r["distance"] for key, r in got.items()} == want
    assert len(want) > 15 and (99, 52) in want and (98, 52) not in want
    for (doc, item), r in got.items():
        if r["distance"] == 0 and item != 52:
            text = next(t for i, t, *_ in rows if i == doc)[r["start"] : r["end"]]
            assert decontaminate.plain(text) == decontaminate.plain(items[item][1])
    docs = spark.read.parquet(f"{folder.path}/documents.parquet")
    kept = {r["doc_id"] for r in decontaminate.stage(spark, docs, folder.path).collect()}
    assert kept == {r[0] for r in rows} - {doc for doc, _ in want}


# --- URL filters --------------------------------------------------------------


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [
        (len(h) + len(p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_verdicts_against_every_rule(spark):
    draw = random.Random(3)
    labels = ["a", "b", "ab", "org", "com", "x-y", "é", "b,a", ""]
    hosts = [".".join(draw.choice(labels) for _ in range(draw.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é"]
    rules = [(draw.choice(["allow", "block"]), draw.choice(hosts), draw.choice(paths)) for _ in range(120)]
    rules += [("allow", "org", "/a"), ("block", "org", "/a"), ("allow", None, "/"), ("block", "", "/")]
    urls = [None, "", "nothing", "://", "HTTP://A.B.ORG/a?x=/#y", "http://org", "a://b://c/d", "s://é.org/a#://"]
    urls += [f"http://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '?q', '#f', '/z'])}" for _ in range(400)]
    urls += ["https://hot.a.org/a/b"] * 300
    rows = [(None if i % 50 == 7 else i, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    got = urlfilter.url_verdicts(pages, table).collect()
    usable = [r for r in rules if r[1]]
    want = [(i, *plain_verdict(u, usable)) for i, u in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_url_query_matches_sql(spark, folder):
    urls = ["http://a.example.org/es/1", "http://example.org/en/12", "http://x.com/fr/", "http://x.com/de/?a",
            "http://org/", "http://org", None, "x", "https://B.Example.ORG/en/2"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    folder.put("pages", spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = urlfilter.op2_url_filter(spark, folder.path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder.path}/pages.parquet/*.parquet'")
    want = db.execute(urlfilter.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- nearest neighbours -------------------------------------------------------


def test_neighbours_against_brute_force(spark, folder):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(4000, 24)).astype(np.float32)
    vectors[1000:2300] = vectors[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5100, []), (5200, [0.0] * 24), (5300, [float("nan")] * 24), (None, [1.0] * 24),
           (5400, [None] + [1.0] * 23), (5500, [1.0, 2.0]), (5501, [1.0, 2.5]), (200, vectors[200].tolist())]
    rows += [(i, v, 0) for i, v in odd]
    folder.put(
        "embeddings",
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3),
    )
    got = {}
    for r in neighbours.op5_neighbours(spark, folder.path).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    exact = vectors.astype(np.float64)
    hits = total = 0
    for q in range(0, 4000, 100):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        want = sorted((d, i) for i, d in enumerate(distance.tolist()) if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        assert all(math.isclose(s, distance[i], rel_tol=1e-12, abs_tol=1e-12) for _, s, i in mine)
        hits += len({i for _, i in want} & {i for *_, i in mine})
        total += 10
        if q == 100:
            assert [(s, i) for _, s, i in mine] == want
    assert hits >= 0.9 * total
    assert got[5500] == [(1, 0.5, 5501)]
    assert set(got) == {*range(0, 4000, 100), 5500}


# --- repeated passages --------------------------------------------------------


def test_suffixes_and_pairs_are_deleted_as_soon_as_they_are_used(spark, folder, monkeypatch):
    base = scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    there = lambda: {n for kind in ("suffixes", "neighbours") for n in glob(f"{base}/{kind}-*")}
    before, during, links = there(), [], suffixes.neighbour_links

    def watched(pairs):
        during.extend(there() - before)
        return links(pairs)

    monkeypatch.setattr(suffixes, "neighbour_links", watched)
    shared = words(7000, 80)
    docs = [(i, " ".join(words(8000 + i, 30) + shared), None, None, None) for i in range(3)]
    folder.docs(docs)
    assert suffixes.op8_repeated_passages(spark, folder.path).count() >= 2
    assert [n.rsplit("/", 1)[1].split("-")[0] for n in during] == ["neighbours"]
    assert there() == before


def test_passages_against_all_pairs(spark, folder):
    shared = [words(7000 + i, n) for i, n in enumerate((50, 51, 64, 120, 400, 40, 30))]
    draw, docs = random.Random(9), []
    for n in range(40):
        parts = words(8000 + n, draw.randint(0, 120))
        for p in draw.sample(range(len(shared)), draw.randint(0, 3)):
            parts += shared[p] + words(9000 + 50 * n + p, draw.randint(1, 40))
        docs.append(parts)
    docs += [docs[3], ["same"] * 300, ["same"] * 200, shared[4][:75] + ["cut"] + shared[4][76:]]
    folder.docs([(i, " ".join(d), None, None, None) for i, d in enumerate(docs)])
    got = suffixes.op8_repeated_passages(spark, folder.path).collect()
    grams = {}
    for i, d in enumerate(docs):
        for at in range(len(d) - 49):
            grams.setdefault(tuple(d[at : at + 50]), set()).add((i, at))
    covered = {}
    for r in got:
        a, b, n = r["start"], r["of_start"], r["n_words"]
        mine, other = docs[r["doc_id"]], docs[r["of_doc_id"]]
        assert n >= 50 and r["doc_id"] != r["of_doc_id"] and mine[a : a + n] == other[b : b + n]
        covered.setdefault(r["doc_id"], set()).update(range(a, a + n))
    for places in grams.values():
        ids = sorted({i for i, _ in places})
        for i, at in places:
            if i != ids[0]:
                # a word that follows a passage twice by chance can be missing
                assert len(set(range(at, at + 50)) - covered.get(i, set())) <= 2, (i, at)


def test_run_hashes_depend_on_the_words_alone():
    known = suffixes.WordHashes()
    text = [w.encode() for w in words(11, 400)]
    own = suffixes.RunHashes(known.of(text))
    for at in (0, 7, 368):
        piece = suffixes.RunHashes(known.of(text[at : at + 32]))
        places = np.array([at])
        assert own.at(places, 32) == piece.at(np.array([0]), 32)
    short = suffixes.RunHashes(known.of(text[:40]))
    same = suffixes.following(short, np.array([0]))
    assert same == suffixes.following(suffixes.RunHashes(known.of(text[:40])), np.array([0]))
    assert same != suffixes.following(own, np.array([0]))
    assert len(suffixes.anchors(suffixes.RunHashes(known.of(text[:31])))) == 0


def test_passages_are_extended_to_their_ends(spark, folder):
    hot, left, right = words(21, 300), words(22, 900), words(23, 700)
    docs = [words(30 + i, 20) + hot + words(60 + i, 20) for i in range(20)]
    docs += [words(90 + i, 5) + left + hot + right + words(95 + i, 5) for i in range(2)]
    folder.docs([(i, " ".join(d), None, None, None) for i, d in enumerate(docs)])
    got = [tuple(r) for r in suffixes.op8_repeated_passages(spark, folder.path).collect()]
    assert (21, 5, 1900, 20, 5) in got
    assert {r[0] for r in got} == set(range(1, 22))


# --- secrets ------------------------------------------------------------------


def test_every_run_but_plain_words_is_a_candidate():
    draw = random.Random(31)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz234567", "0123456789abcdef", "ABCDEFGHJKMNPQRS0123456789"):
        for size in (6, 8, 12, 24, 64):
            for _ in range(200):
                value = "".join(draw.choices(alphabet, k=size))
                if not value.isalpha() or size > 20:
                    assert secrets.candidates(f"see {value} here") == [(4, 4 + size)], value
    for value in ("1234567890abcdef", "48210573qwertyuiop", "q" * 21, "XK" * 11):
        assert secrets.candidates(value) == [(0, len(value))]
    for word in ("already", "Berlin.", "LONDON", "under_"):
        assert secrets.candidates(word) == []


def plain_base(text):
    kinds = [
        (r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted(
        (m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)
    )


PIECES = ["secret", "token: ", "API_KEY=", "apikey", "=", ": ", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 3,
          "0123456789abcdef01234567", "passwd", '"', "'", " ", "x", "\n", "ſecret=abcdefgh", "toKen=abcdefgh", "é"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_findings(text):
    assert secrets.base_findings(text) == plain_base(text)


def secret_texts(n, seed):
    draw, rows = random.Random(seed), []
    for i in range(n):
        body = text_of(seed + i, 60)
        kind = i % 4
        if kind == 0:
            body += f' token = "{draw.randbytes(20).hex()}" '
        elif kind == 1:
            body += " password: " + "".join(draw.choices("abcXYZ0189+/", k=24)) + " "
        elif kind == 2:
            body += " order " + "".join(draw.choices("0123456789", k=16)) + " "
        rows.append((i, body + text_of(seed + i + 7, 20), None, None, None))
    return rows


def test_network_on_held_out_findings():
    net = secrets.train([r[1] for r in secret_texts(400, 100)])
    x, y = secrets.training_rows([r[1] for r in secret_texts(200, 90_000)])
    found = net.probability(x) >= net.threshold
    assert len(set(y)) == 2
    assert found[y > 0].mean() >= 0.9 and found[y == 0].mean() <= 0.05


def test_query_keeps_base_spans(spark, folder):
    rows = secret_texts(120, 3) + [(500, None, None, None, None), (501, "", None, None, None)]
    folder.docs(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in secrets.op10_secrets(spark, folder.path).collect():
        base = plain_base(texts[r["doc_id"]])
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[1] == k for b in base) for k in range(3)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_no_findings_to_learn_from():
    net = secrets.train(["plain prose only"] * 5)
    assert net.threshold > 1


def test_network_learns_from_every_document(spark, folder, monkeypatch):
    rows = secret_texts(300, 100)
    # behind 20,000 characters, and many copies of one text
    rows += [(400 + i, text_of(i, 4000) + " password: kX9" + "qW7z/" * (3 + i), None, None, None) for i in range(3)]
    rows += [(500 + i, "see ticket-4821-open again", None, None, None) for i in range(400)]
    folder.docs(rows)
    docs = spark.read.parquet(f"{folder.path}/documents.parquet")
    x, y, _ = secrets.labelled([r[1] for r in rows])
    seen = secrets.training_windows(docs).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in seen} == {True: y.sum(), False: (y == 0).sum()}
    monkeypatch.setattr(secrets, "SHARD_ROWS", 200)
    net = secrets.learn(docs)
    x, y = secrets.training_rows([r[1] for r in secret_texts(200, 90_000)])
    found = net.probability(x) >= net.threshold
    assert found[y > 0].mean() >= 0.9 and found[y == 0].mean() <= 0.05
    # whatever the layout of the input
    again = secrets.learn(docs.repartition(7))
    assert np.array_equal(net.parameters(), again.parameters())
    assert (net.threshold, net.precision) == (again.threshold, again.precision)


@pytest.mark.parametrize("text", ["", "a", "é" * 300])
def test_windows_of_any_text(text):
    assert secrets.window(text, 0, len(text)).shape == (secrets.WIDTH,)


def test_threshold_keeps_the_recall_where_classes_overlap():
    net = secrets.Network.start()
    draw = np.random.default_rng(1)
    y = (draw.random(2000) < 0.3).astype(float)
    logits = draw.normal(0, 1, 2000) + y
    net.logits = lambda x: logits[x[:, 0]]
    x = np.arange(2000)[:, None]
    net.calibrate(x, y)
    found = net.probability(x) >= net.threshold
    assert found[y > 0].mean() >= secrets.RECALL
    assert net.precision == y[found].mean()


def test_candidates_without_digits_short_or_dotted():
    text = "a hQkzPwTbXvRmLc b xK4q2Z c eyJhbGci.eyJzdWIi.SflKxw d plain Words, here. e " + "x1" * 300
    want = ["hQkzPwTbXvRmLc", "xK4q2Z", "eyJhbGci.eyJzdWIi.SflKxw", "x1" * 300]
    assert [text[a:b] for a, b in secrets.candidates(text)] == want


@pytest.mark.parametrize("n", [6, 48, 49, 72, 73, 200, 1001])
def test_windows_cover_a_candidate(n):
    spans = secrets.pieces(10, 10 + n)
    assert {i for a, b in spans for i in range(a, b)} == set(range(10, 10 + n))
    assert all(b - a <= secrets.SPAN for a, b in spans)


def test_secret_behind_harmless_characters_is_read(spark, folder):
    net = secrets.train([r[1] for r in secret_texts(400, 100)])
    value = random.Random(4).randbytes(20).hex().upper()
    text = "see " + "plain/path/" * 9 + value + " there"
    (start, end), = secrets.candidates(text)
    seen = [secrets.window(text, a, b) for a, b in secrets.pieces(start, end)]
    codes = secrets.CLASS_OF[[ord(c) for c in value[-20:]]]
    assert any((w[secrets.BEFORE + secrets.SPAN - 20 : secrets.BEFORE + secrets.SPAN] == codes).all() for w in seen)
    folder.docs([(1, text, None, None, None)])
    found = secrets.scan(spark.read.parquet(f"{folder.path}/documents.parquet"), net).collect()
    best = net.probability(np.array(seen)).max()
    assert (found[0]["spans"] != "") == (best >= net.threshold)


def test_documents_of_one_id_are_told_apart_once(spark):
    """Contexts and suffixes of repeated rows were made for every row, with a key for each."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (None, "c"), (3, "d")]
    got = suffixes.once(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {(r["doc_id"], r["text"]) for r in got} == set(rows)
    assert {r["doc_id"] for r in got if r["k"] == 0} == {2, 3}
    assert len({(r["doc_id"], r["k"]) for r in got}) == 6


def test_a_join_reads_the_contexts_of_its_side(spark):
    docs = [(k, f"w{k} " + " ".join(f"x{i}" for i in range(40))) for k in range(3)]
    docs = suffixes.once(spark.createDataFrame(docs, "doc_id long, text string"))
    found = [(1, 0, 1, 41, 0, 0, 1, 41), (2, 0, 1, 41, 0, 0, 1, 41), (2, 0, 1, 41, 1, 0, 1, 41)]
    kinds = ["long", "long", "int", "int"] * 2
    found = spark.createDataFrame(found, ", ".join(map(" ".join, zip(suffixes.RUN, kinds))))
    sides = {r["c_id"]: (r["here"], r["there"]) for r in suffixes.contexts(docs, found).collect()}
    assert sides == {0: (False, True), 1: (True, True), 2: (True, False)}
    assert len(suffixes.extended(docs, found, 8).collect()) == 3
