import hashlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandstream.llm import alignment

ODD = [
    "plain words, plain text", "é日本 \U0001f600x a", "a\nb\r\n\tc  d   e ", "  lead", "ﬁ Ａ",
    "<|endoftext|> <s> <unk> <0x41>", "don't we'll", "x" * 3000, "日本語のテキスト", "a\x00b",
    "\U0001f468‍\U0001f469‍\U0001f467 family", "é ́", " ", "\n", "1234567 8901", "ends in one ", "a \n", "a \n ", "  ",
]


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(*alignment.default_paths())


def plain(tool, text):
    """Groups (A ids, B ids) by cumulated byte lengths of the whole text; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    sides = [(a, [tool.a_bytes[i] for i in a]), (b, [tool.b_bytes[i] for i in b])]
    if any(b"".join(parts) != whole for _, parts in sides):
        return None
    ends = []
    for _, parts in sides:
        at, found = 0, []
        for p in parts:
            at += len(p)
            found.append(at)
        ends.append(found)
    cut, begin = sorted(set(ends[0]) & set(ends[1])), 0
    out = []
    for end in cut:
        out.append([
            [i for i, e in zip(ids, found) if begin < e <= end]
            for (ids, _), found in zip(sides, ends)
        ])
        begin = end
    return out


def shown(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def by_units(tool, text):
    units = tool.units(alignment.UNITS(" " + text)) if text else []
    return None if any(u is None for u in units) else ";".join(u[0] for u in units)


def check(tool, text):
    want = plain(tool, text)
    found = by_units(tool, text)
    (whole,) = tool.units([" " + text])
    if want is None:
        assert not text or found is None and whole is None
    else:
        assert found == whole[0] == shown(want)
        assert np.frombuffer(whole[1], "<i8")[3] == sum(len(a) * len(b) for a, b in want)


@pytest.mark.parametrize("text", ODD)
def test_chosen_texts(tool, text):
    check(tool, text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(tool, text):
    check(tool, text)


@given(st.text(alphabet="ab e'\n é日\U0001f600▁1,", max_size=60))
@settings(max_examples=300, deadline=None)
def test_texts_of_few_characters(tool, text):
    check(tool, text)


def test_short_units_are_encoded_together(tool, monkeypatch):
    """Calls of the tokenizers for each unit were most of the operator's time."""
    units = [f" {w}{k}{end}" for k in range(300) for w, end in (("the", ""), ("é日", ","), ("a", "\nb"))]
    units += [" a▁b", " ▁"]  # these do not decode to themselves
    alone = [tool.unit(*row) for row in tool.spans(units)]
    calls, spans = [], tool.spans
    monkeypatch.setattr(tool, "spans", lambda texts: calls.extend(texts) or spans(texts))
    found = tool._learn(units)
    assert 2 <= len(calls) <= alignment.FEW_UNITS and {" a▁b", " ▁"} <= set(calls)

    def read(unit):
        n = np.frombuffer(unit[1], "<i8")
        pairs, times = n[5 : 5 + n[4]], n[5 + n[4] :]
        return unit[0], n[:5].tolist(), dict(zip(pairs, times if len(times) else [1] * len(pairs)))

    assert alone[-2:] == [found[u] for u in units[-2:]] == [None, None]
    assert [read(found[u]) for u in units[:-2]] == [read(u) for u in alone[:-2]]


@given(st.lists(st.text(alphabet="abz'\n.é日\u0301ﬁ1,\U0001f600▁", min_size=1, max_size=6), max_size=8))
@settings(max_examples=300, deadline=None)
def test_units_of_a_line(tool, words):
    """Where a line gives units, they are those that the units give alone."""
    units = [f" {w}" for w in words if alignment.one_line(f" {w}")]
    made = tool.line(units) if units else None
    if made is not None:
        alone = [tool.unit(*row) for row in tool.spans(units)]
        assert [u[0] for u in made] == [u[0] for u in alone]
        numbers = [[np.frombuffer(u[1], "<i8")[:5].tolist() for u in some] for some in (made, alone)]
        assert numbers[0] == numbers[1]


def test_small_cache(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 3)
    tool = alignment.Aligner(*alignment.default_paths())
    for _ in range(3):
        for text in ODD:
            check(tool, text)


def expected(tool, texts):
    groups = {k: plain(tool, t) for k, t in texts.items()}
    pairs = {
        k: [p for a, b in found or () for p in product(a, b)] for k, found in groups.items()
    }
    held = Counter(p for links in pairs.values() for p in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    for k, found in groups.items():
        links = pairs[k]
        digest = hashlib.sha256(shown(found).encode()).hexdigest() if found else ""
        yield k, (
            sum(len(a) for a, _ in found or ()), sum(len(b) for _, b in found or ()),
            len(found or ()), len(links), sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links), digest,
        )


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 23])
def test_query_against_all_links(spark, folder, tool, block_bytes, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    texts = dict(enumerate([*ODD, None, "", "plain words", "▁ piece", "plain words"]))
    folder.docs([(i, t, None, None, None) for i, t in texts.items()], ["block", "pairs", "raw"])
    rows = alignment.op11_alignment(spark, folder.path).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == dict(expected(tool, texts))
    assert len(rows) == len(texts)


def test_groups_as_a_column(spark, tool):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*ODD, None])], "k int, text string, GROUPS string")
    for row in alignment.aligned(df).collect():
        want = plain(tool, row["text"]) or []
        assert [[g["a"], g["b"]] for g in row["groups"]] == want
        if want:
            assert row["groups"][-1]["end"] == len(row["text"].encode()) + 1
