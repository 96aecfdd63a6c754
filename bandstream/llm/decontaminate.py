"""Benchmark decontamination by pigeonhole edit matching (operator 1).

A test item of ``m`` characters may occur with up to ``k = RATE * m`` edits.  Cut
into ``k + 1`` pieces, at least one piece of every such occurrence is untouched.
One Aho-Corasick pass over a text finds all pieces of all items; around each hit
Myers' bit-parallel algorithm measures the edit distance of the whole item.

Both sides are compared as lower-case words separated by one space; punctuation
and layout do not count.  An item too short for any edit must occur exactly, as
whole words.  Items without words, null items, and null or empty texts match
nothing.  Repeated documents each get their rows; of several occurrences of an
item in a document the one with the smallest distance, then the first, is given.

The items pass the driver in blocks of at most ``BLOCK_CHARS`` characters, one
pass over the documents each, so the benchmark may have any size.  Documents are
never shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import fields, fresh, table, text_bytes

RATE = 0.08
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-case words, one space before, between and after them."""
    return f" {' '.join(WORD.findall(text.lower()))} "


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed for an item of ``length`` characters."""
    return int(length * rate)


def myers(pattern: dict, m: int, text: str, limit: int):
    """(distance, end) of the best occurrence within ``limit``, the first of equals."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = limit + 1, -1
    get = pattern.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (mask & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        plus = mh | (mask & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, at
    return (best, end) if best <= limit else None


def masks(text: str) -> dict:
    """Bit mask of the positions of each character."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The pieces of a block of items and what verifies them."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.items = []
        pieces: dict[str, list] = {}
        for item_id, text in items:
            body = plain(text or "")[1:-1]
            if not body:
                continue
            k = budget(len(body), rate)
            if k == 0:
                body = f" {body} "
            n = len(self.items)
            self.items.append((item_id, body, k, masks(body), masks(body[::-1])))
            cuts = [len(body) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(body[a:b], []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def windows(self, text: str) -> dict[int, list]:
        """Stretches of the text around piece hits, per item, merged and in order."""
        found: dict[int, list] = {}
        if not self.items:
            return found
        for end, (size, places) in self.pieces.iter(text):
            for n, offset in places:
                _, body, k, *_ = self.items[n]
                start = end + 1 - size - offset
                low, high = max(0, start - k), start + len(body) + k
                spans = found.setdefault(n, [])
                spans.append((low, high))
        for spans in found.values():
            spans.sort()
            merged = [spans[0]]
            for low, high in spans[1:]:
                if low <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
                else:
                    merged.append((low, high))
            spans[:] = merged
        return found

    def matches(self, text: str) -> list[tuple]:
        """(item number, distance, start, end) in the plain text."""
        out = []
        for n, spans in self.windows(text).items():
            _, body, k, forward, backward = self.items[n]
            best = None
            for low, high in spans:
                hit = myers(forward, len(body), text[low:high], k if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], low, low + hit[1])
                    if not hit[0]:
                        break
            if best:
                distance, low, end = best
                reach = text[max(low, end - len(body) - k) : end][::-1]
                back = myers(backward, len(body), reach, distance)
                out.append((n, distance, end - back[1], end))
        return out

    def dirty(self, text: str) -> bool:
        return bool(self.matches(plain(text)))


@lru_cache(maxsize=2)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS):
    """The items as lists of bounded size."""
    block, chars = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        if block and chars + len(row[1]) > size:
            yield tuple(block)
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield tuple(block)


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the plain positions lie in the text itself."""
    at, first, last = 1, None, 0
    for m in WORD.finditer(text):
        size = len(m[0].lower())
        if first is None and at + size > start:
            first = m.start()
        if at < end:
            last = m.end()
        at += size + 1
    return first or 0, last


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points) of every occurrence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    schema = fields(f"doc_id {kind}, item_id {item}, distance int, start int, end int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = context.broadcast(block)

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, rate)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    for n, distance, start, end in matcher.matches(plain(text)):
                        span = original_span(text, start, end)
                        found.append((doc_id, matcher.items[n][0], distance, *span))
                yield pd.DataFrame(found, columns=schema.names)

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go; the others stay as they are."""
    (raw,) = fresh(docs, "raw")
    for block in blocks(table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, RATE)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                clean = [not matcher.dirty(t.decode()) for t in texts]
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                yield kept.filter(pa.array(clean))

        docs = docs.select(*docs.columns, text_bytes().alias(raw)).mapInArrow(run, docs.schema)
    return docs
