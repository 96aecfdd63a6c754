"""Byte-level BPE with a contiguous rank array (operator 9).

A word is a list of part ids and a list of the ranks of adjacent pairs.  The
smallest rank is found by scanning, its right part deleted, and the ranks on
both sides looked up again.  For the short words of running text the scan beats
any other structure; words above ``LONG`` bytes use a heap over linked parts,
which merges in the same order (lowest rank, then leftmost).

Null texts are empty texts and have no tokens.  Equal texts get equal rows.
Texts are encoded whole.  The vocabulary file is a parameter and is read once
per Python worker.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import fields, fresh, table, text_bytes

LONG = 256
#: Words remembered per Python worker, and the longest such word.
CACHE_WORDS = 200_000
CACHE_CHARS = 64
NO_RANK = 1 << 40

WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [ids[c] for c in alphabet]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.words = regex.compile(WORDS)
        ordered = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < n:
                r = self.rank.get((parts[i], parts[j]))
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _plain(self, text: str, out: list[bytes]) -> None:
        known = self.known
        for word in self.words.findall(text):
            ids = known.get(word)
            out.append(self._word(word) if ids is None else ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for hit in self.specials.finditer(text) if self.specials else ():
            self._plain(text[at : hit.start()], out)
            out.append(self.special[hit.group()].to_bytes(4, "little"))
            at = hit.end()
        self._plain(text[at:], out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None
) -> DataFrame:
    """Add ``ids``: the packed token ids of ``text``."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            packed = [vocabulary(path).encode(t.decode()) for t in texts]
            columns = [*batch.columns[:-1], pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], ids])

    (raw,) = fresh(df, "raw")
    rows = df.select(*df.columns, text_bytes(text).alias(raw))
    schema = fields("")
    for field in [*df.schema, *fields(f"`{ids}` binary")]:
        schema.add(field)
    return rows.mapInArrow(run, schema)


def decode(
    df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None
) -> DataFrame:
    """Add ``decoded``: the text of the packed ``ids``; null ids are no tokens."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            packed = batch.column(batch.schema.names.index(ids)).to_pylist()
            texts = [vocabulary(path).decode(p or b"") for p in packed]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, decoded])

    schema = fields("")
    for field in [*df.schema, *fields(f"`{decoded}` string")]:
        schema.add(field)
    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of tokens and digests of its ids and decoded text."""
    both = decode(encode(docs.select("doc_id", "text"), path=path).drop("text"), path=path)
    return both.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents with their packed token ids in place of the text."""
    (packed,) = fresh(docs, "ids")
    encoded = encode(docs, ids=packed)
    keep = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens")]
    return encoded.select(
        *keep,
        F.expr(f"length(`{packed}`) div 4").cast("long").alias("n_tokens"),
        F.col(packed).alias("ids"),
    )
