import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bandstream.llm import packing


@pytest.fixture(scope="module")
def both():
    path = packing.default_path()
    return packing.Words(path), Tokenizer.from_file(path)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def same(both, text):
    ours, theirs = both
    ids, sizes = ours.encode(pa.array([text, "", text]))
    want = ids_of(theirs, text)
    assert ids.tolist() == want * 2 and sizes.tolist() == [len(want), 0, len(want)]


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(both, text):
    same(both, text)


@given(st.text(alphabet="aBé 'sΣΑ\n\t\x1c\x85\xa0̧́İ1１日<|endotxsar>", max_size=50))
@settings(max_examples=400, deadline=None)
def test_texts_of_few_characters(both, text):
    same(both, text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "The END<|endoftext|>x <|startoftext|>", "ΟΔΟΣ ΟΔΟΣ.", "don't WE'LL", "e ́", "x" * 5000,
     "a\x1cb\x85c d e", "\U0001f600 ok"],
)
def test_chosen_texts(both, text):
    same(both, text)


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    ours, theirs = packing.Words(packing.default_path()), both[1]
    texts = ["One two, THREE four's five", "ÉTÉ été. Straße x" * 9, "one " + "y" * 90 + " two"]
    for _ in range(3):
        ids, sizes = ours.encode(pa.array(texts))
        want = [ids_of(theirs, t) for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_many_in_one_line(both):
    ours, theirs = packing.Words(packing.default_path()), both[1]
    ours.tokenizer = Counting(ours.tokenizer)
    text = " ".join(f"{a}{b}{c}" for a in "bcdfgÉh" for b in "aeiouà" for c in map(chr, range(97, 123)))
    ids, sizes = ours.encode(pa.array([text, text.upper(), text.title() + "."]))
    assert ids.tolist() == ids_of(theirs, text) * 3 + ids_of(theirs, ".") and len(sizes) == 3
    assert ours.tokenizer.texts <= 20  # of 1093 words


PIECES = ["One", "two,", "don't", "L'ÉTÉ", "×", "a÷b", "ÿÀß", "x9y", "42", "日本", "e\u0301", "é\u0301", "<|", "|>",
          "<|endoftext|>", "<|ENDOFTEXT|>", "a<b", "</w>", "\x1c", "\x85", "\u3000", "\ufb01", "İ", "!?", "\x00"]


@given(st.lists(st.lists(st.sampled_from([*PIECES, " ", " ", "\n"]), max_size=12).map("".join), max_size=8))
@settings(max_examples=400, deadline=None)
def test_many_texts_in_one_buffer(both, texts):
    ours, theirs = both
    want = [ids_of(theirs, t) for t in texts]
    for skipped in (0, 1):  # a slice keeps the buffers of the whole
        ids, sizes = ours.encode(pa.array(texts, pa.string())[skipped:])
        assert ids.tolist() == sum(want[skipped:], []) and sizes.tolist() == [len(w) for w in want[skipped:]]


def test_vocabulary_without_marked_ends(both):
    ours, theirs = packing.Words(packing.default_path()), both[1]
    ours.last[:] = False
    ids, _ = ours.encode(pa.array(["Plain words, not in a line"]))
    assert ids.tolist() == ids_of(theirs, "Plain words, not in a line")


def test_chunks_join_batches(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 100)
    texts = ["x" * n for n in (5, 0, 300, 20, 20, 5)]
    batches = [pa.record_batch({"i": [k], "t": pa.array([t.encode()])}) for k, t in enumerate(texts)]
    empty = batches[0].slice(0, 0)
    joined = list(packing.chunks([empty, *batches, empty]))
    assert [len(ids) for ids, _ in joined] == [2, 1, 3]
    assert [i for ids, _ in joined for i in ids.to_pylist()] == list(range(6))
    assert [t for _, column in joined for t in column.to_pylist()] == texts


def slow(lengths, size, limit):
    """The same rule over a sorted list of (free, number)."""
    bins, out, number = [], [], 0
    for length in lengths:
        at = bisect_left(bins, (length, -1))
        if at < len(bins):
            free, chosen = bins.pop(at)
        else:
            if len(bins) >= limit:
                bins.pop(0)
            free, chosen, number = size, number, number + 1
        out.append(size - free)
        if free > length:
            insort(bins, (free - length, chosen))
    return out, number


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_packer_against_a_sorted_list(lengths, limit):
    packer = packing.Packer(40, limit)
    closed = []
    for k, length in enumerate(lengths):
        closed += packer.add(length, k)
        assert packer.open <= limit
    offsets, number = slow(lengths, 40, limit)
    closed += packer.rest()
    placed = {item: at for _, held in closed for item, at in held}
    assert [placed[k] for k in range(len(lengths))] == offsets
    assert packer.number == number == len(closed)


def whole(rows, size):
    """Every sequence is gapless from 0 and within its size."""
    of = {}
    for r in rows:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in of.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return of


@pytest.mark.parametrize("per_task,bins", [(10**6, 64), (300, 16), (50, 1000)])
def test_rounds(spark, per_task, bins):
    draw = random.Random(5)
    items = [(k, draw.choice([1, 3, 50, draw.randint(1, 100)])) for k in range(2000)]
    df = spark.createDataFrame(items, "k long, length long")
    rows = packing.pack(df, 100, bins, per_task).collect()
    assert sorted((r["k"], r["length"]) for r in rows) == items
    used = len(whole(rows, 100))
    assert used <= 1.06 * sum(n for _, n in items) / 100 + 2


def test_query(spark, folder):
    tokenizer = Tokenizer.from_file(packing.default_path())
    texts = ["Some text.\nMore", None, "", "<|endoftext|>z", "café " * 50, "go " * 4095, "go " * 4096, "a1 " * 9000]
    folder.docs([(i, t, None, None, None) for i, t in enumerate(texts)] * 2, ["piece", "START", "ids"])
    rows = packing.op13_packing(spark, folder.path).collect()
    whole(rows, 4096)
    for i, text in enumerate(texts):
        ids = np.array([*ids_of(tokenizer, text), 1], dtype="<u4")
        want = [
            (k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
            for k, at in enumerate(range(0, len(ids), 4096))
            for _ in range(2)
        ]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert got == want


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three " * 20), (2, "four"), (3, None)], "doc_id long, text string")
    cut = packing.pieces(docs, size=16, ids=True)
    packed = packing.pack(cut, 16)
    held = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = held[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
    assert all(len(ids) <= 64 for ids in held.values())
