import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from bandstream.llm import graph, simhash
from bandstream.llm.common import stored
from bandstream.llm.graph import components

from .conftest import text_of, words


def plain_fingerprint(text, size=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(parts[i : i + size]) for i in range(max(1, len(parts) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if parts else []
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    return {n: find(n) for n in nodes}


@given(st.text(alphabet="aBÉ \t\n\x1c x", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=12, unique=True), st.data())
@settings(max_examples=100, deadline=None)
def test_meeting_finds_the_components_of_all_links(values, data):
    near = [
        v ^ sum(1 << b for b in data.draw(st.sets(st.integers(0, 63), max_size=5)))
        for v in values
    ]
    prints = sorted(set(values + near))
    bits = 6
    heads = simhash.flips(bits, 2)
    own = np.array(prints, dtype=np.uint64)
    cells = ((own >> np.uint64(64 - bits))[:, None] ^ heads).reshape(-1)
    sent = np.repeat(own, len(heads))
    found = []
    for cell in np.unique(cells):
        here = cells == cell
        for at_once in (2_000_000, 5_000):
            pairs = simhash.meet(cells[here], sent[here], bits, at_once)
            found += simhash.forest(pairs).tolist()
    true = [
        (a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4
    ]
    assert plain_components(found, prints) == plain_components(true, prints)


def test_components(spark):
    links = [(i + 1, i) for i in range(0, 40)] + [(100, 101), (101, 103), (102, 103), (7, 7)]
    links += [(200, 200 + i) for i in range(1, 30)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    nodes = {n for link in links for n in link}
    want = plain_components(links, nodes)
    assert {r["node"]: r["root"] for r in got} == {n: r for n, r in want.items() if n != r}


def near_copy(text, at):
    parts = text.split(" ")
    parts[at % len(parts)] = "changed"
    return " ".join(parts)


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """Each round is a plan with some eight exchanges, which the driver holds."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, label: made.append(1) or stored(df, label))
    links = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(1, 41)] + [(101, 100), (102, 100)]
    assert len(made) == 1


def test_rounds_over_the_stars_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 3)
    draw = random.Random(8)
    links = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(450)]
    links += [(k, k + 1) for k in range(1000, 1200)] + [(k, 2000) for k in range(1500, 1600)]
    draw.shuffle(links)
    edges = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = [tuple(r) for r in components(edges.sortWithinPartitions("v")).collect()]
    nodes = {n for link in links for n in link}
    want = plain_components(links, nodes)
    assert len(got) == len(set(got))
    assert dict(got) == {n: r for n, r in want.items() if n != r}


def test_query_against_all_pairs(spark, folder):
    texts = [text_of(i, 60 + i) for i in range(30)]
    texts += texts[:5] + [texts[3].upper()] + [near_copy(text_of(50, 2000), 100 * k) for k in range(12)]
    texts += ["", None, "word", "word"]
    ids = [(37 * i) % 1009 for i in range(len(texts))]
    folder.docs([(i, t, None, None, None) for i, t in zip(ids, texts)])
    got = {r["doc_id"]: r for r in simhash.op6_simhash(spark, folder.path).collect()}
    prints = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    links = [
        (a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    assert {i: r["fingerprint"] for i, r in got.items()} == {
        i: f"{p:016x}" for i, p in prints.items()
    }
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(links, ids)


def test_stage_keeps_one_of_each_group(spark, folder):
    """Near copies at a five-word Jaccard of 0.8 and more go, other texts stay."""
    rows, groups = [], {}
    for g in range(12):
        base = words(1000 + g, 300)
        for c in range(4):
            copy = list(base)
            for e in range(c):
                copy[37 * e + 11 * c] = f"edit{g}{c}{e}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    passage = " ".join(words(5, 60))
    for s in range(10):
        groups[len(rows)] = 100 + s
        rows.append((len(rows), f"{passage} {text_of(300 + s, 200)}", "en", "s", 0))
    docs = folder.docs(rows).spark.read.parquet(f"{folder.path}/documents.parquet")
    kept = [r["doc_id"] for r in simhash.stage(spark, docs, folder.path).collect()]
    assert sorted(groups[i] for i in kept) == sorted(set(groups.values()))
    assert kept and all(i == min(k for k, g in groups.items() if g == groups[i]) for i in kept)


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**9, 10**12])
def test_cells_keep_their_size(n):
    bits = simhash.cell_bits(n)
    rows = n * len(simhash.flips(bits, 2)) / 2**bits
    assert rows <= simhash.CELL_ROWS or bits == 32


def kept_of(spark, folder, texts):
    docs = folder.docs([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    docs = docs.spark.read.parquet(f"{folder.path}/documents.parquet")
    return {r["doc_id"] for r in simhash.stage(spark, docs, folder.path).collect()}


def five_words(parts):
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def test_stage_finds_cut_and_appended_copies(spark, folder):
    """Block edits at a five-word Jaccard just above 0.8 are found like scattered ones."""
    texts, copies = [], set()
    for g in range(30):
        base = words(2000 + g, 150 + 20 * g)
        short = base[: int(0.82 * len(base))]
        added = base + words(7000 + g, int(0.18 * len(base)))
        for parts in (base, short, added)[:: 1 if g % 2 else 2]:
            both = five_words(base) | five_words(parts), five_words(base) & five_words(parts)
            assert len(both[1]) >= 0.8 * len(both[0])
            copies |= {len(texts)} if parts is not base else set()
            texts.append(" ".join(parts))
    assert kept_of(spark, folder, texts) == set(range(len(texts))) - copies


def test_stage_meets_in_the_balls_of_the_operator(spark, folder, monkeypatch):
    """Copies whose fingerprints meet are found by the balls alone, whatever their keys."""
    texts, copies = [], set()
    for g in range(30):
        base = words(3000 + g, 600)
        copy = [*base[:300], f"edit{g}", *base[301:]]
        a, b = (simhash.profile(" ".join(t).encode())[2][0] for t in (base, copy))
        if (a ^ b).bit_count() <= 2 * simhash.RADIUS:
            copies.add(len(texts) + 1)
        texts += [" ".join(base), " ".join(copy)]
    assert len(copies) >= 10
    draw = np.random.default_rng(1)
    monkeypatch.setattr(
        simhash, "profile", lambda t, real=simhash.profile: (
            real(t)[0], draw.integers(0, 2**63, simhash.BANDS, dtype=np.uint64), real(t)[2]
        )
    )
    assert copies <= set(range(len(texts))) - kept_of(spark, folder, texts)


def test_stage_keeps_what_is_below_the_limit(spark, folder):
    """Pairs at a five-word Jaccard just below 0.8 are not near duplicates."""
    texts = []
    for g in range(40):
        base = words(4000 + g, 200)
        copy = list(base)
        for e in range(4 + g % 6):
            copy[10 + 15 * e] = f"edit{g}x{e}"
        a, b = five_words(base), five_words(copy)
        if len(a & b) < 0.8 * len(a | b):
            texts += [" ".join(base), " ".join(copy)]
    assert len(texts) >= 40
    assert kept_of(spark, folder, texts) == set(range(len(texts)))


def bounded_links(spark, sets, block, turns, monkeypatch):
    """The stage's links between shingle sets that all meet at one key."""
    names = [f"s{k}" for k in range(simhash.SKETCH_WORDS)]
    profile = [[7] * len(names)] * len(sets)
    meeting = spark.createDataFrame(
        [(1, n, *s) for n, s in zip(sets, profile)], "key long, node long, " + ", ".join(f"{n} long" for n in names)
    )
    shingles = spark.createDataFrame(
        [(n, list(s)) for n, s in sets.items()], "node long, shingles array<long>"
    )
    monkeypatch.setattr(simhash, "meetings", lambda same: meeting)
    monkeypatch.setattr(simhash, "shingle_sets", lambda *a: shingles)
    monkeypatch.setattr(simhash, "TURNS", turns, raising=False)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    return [(r["u"], r["v"]) for r in simhash.linked(None, None).collect()]


@pytest.mark.parametrize("block,turns", [(500_000, 2), (100, 0), (100, 1)])
def test_links_do_not_depend_on_the_head_of_a_key(spark, monkeypatch, block, turns):
    """Sets that meet at a key are linked although other sets there are unlike them."""
    sets = {}
    for g in range(8):
        for c in range(3):
            sets[10 * g + c] = [1000 * g + i for i in range(40)] + [1000 * g + 500 + c]
    sets |= {500 + k: [90_000 + k] for k in range(6)}
    found = bounded_links(spark, sets, block, turns, monkeypatch)
    true = [(10 * g + c, 10 * g) for g in range(8) for c in (1, 2)]
    assert plain_components(found, sets) == plain_components(true, sets)


def test_stage_compares_copies_whatever_else_has_their_words(spark, folder):
    """Texts of the same words in other orders do not hide two copies from each other."""
    texts, copies = [], set()
    for g in range(6):
        base = words(6000 + g, 200)
        texts.append(" ".join(base))
        copies.add(len(texts))
        texts.append(" ".join(base[150:] + base[:150]))
        for k in range(6):
            other = list(base)
            random.Random(10 * g + k).shuffle(other)
            texts.append(" ".join(other))
    assert kept_of(spark, folder, texts) == set(range(len(texts))) - copies
