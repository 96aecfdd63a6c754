"""Nearest neighbours with a hash-prefix forest (operator 5).

Vectors are indexed in shards of at most ``SHARD`` rows, each inside one task.
For every tree a shard has one sorted array of ``DEPTH``-bit hash strings (sides
of random hyperplanes through the shard's medians).  A query descends in all
trees of a shard to the longest prefix that still matches, then ascends in all
of them together, one bit at a time, until at least ``CANDIDATES`` entries share
its prefix; only these are compared exactly.  The best of all shards are merged.

Queries are taken in blocks of at most ``BLOCK``, each handed to all shards, so
neither the driver nor a task ever holds more than one block; every block leaves
its part of the result in shared storage.  Nothing is fitted globally.

Equal vectors of a shard are one entry.  It stands for its smallest ids, as many
as an answer can hold, which loses nothing because ties go to smaller ids; so a
vector that makes up a third of the table does not fill the prefix matches.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, neither do rows without vec_id.  Only vectors of one length are
compared.  A row with the query's own id is never its answer; an id that is
repeated is listed once, at its smallest distance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandstream.llm.common import stored, table

TREES = 48
DEPTH = 32
CANDIDATES = 3000
SHARD = 8192
BLOCK = 20_000
NEAREST = 10


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (doubles) of the rows that take part."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>"))
        .where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        .where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    )


@lru_cache(maxsize=4)
def planes(size: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(20_240 + size).normal(size=(size, trees * DEPTH))


class Forest:
    """Sorted hash strings of the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nearest: int, trees: int = TREES):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        by_entry = np.argsort(entry.reshape(-1), kind="stable")
        first = np.searchsorted(entry.reshape(-1)[by_entry], np.arange(len(self.vectors) + 1))
        self.members = [
            np.unique(ids[by_entry[a:b]])[: nearest + 1] for a, b in zip(first, first[1:])
        ]
        self.trees = trees
        self.planes = planes(vectors.shape[1], trees)
        sides = self.vectors @ self.planes
        self.middle = np.median(sides, axis=0)
        codes = self.codes(self.vectors, sides)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def codes(self, vectors: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
        """One hash string per vector and tree."""
        sides = vectors @ self.planes if sides is None else sides
        bits = (sides > self.middle).reshape(len(vectors), self.trees, DEPTH)
        return bits @ (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))

    def ranges(self, codes: np.ndarray, depth: int):
        """Where the entries with the same first ``depth`` bits start and end."""
        low = codes >> (DEPTH - depth) << (DEPTH - depth)
        high = low + (1 << (DEPTH - depth))
        columns = range(self.trees)
        find = lambda at: np.stack(
            [np.searchsorted(self.sorted[:, t], at[:, t]) for t in columns], axis=1
        )
        return find(low), find(high)

    def search(self, queries: np.ndarray, wanted: int):
        """Per query the candidate entries."""
        codes = self.codes(queries)
        starts = np.zeros_like(codes)
        ends = np.zeros_like(codes)
        open_ = np.ones(len(queries), dtype=bool)
        for depth in range(DEPTH, -1, -1):
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            low, high = self.ranges(codes[rows], depth)
            starts[rows], ends[rows] = low, high
            open_[rows[(high - low).sum(axis=1) >= wanted]] = False
        for q in range(len(queries)):
            seen = np.zeros(len(self.vectors), dtype=bool)
            for t in range(self.trees):
                seen[self.order[starts[q, t] : ends[q, t], t]] = True
            yield np.flatnonzero(seen)

    def nearest(self, own: int, query: np.ndarray, found: np.ndarray, nearest: int):
        """The best (distance, id) among the candidate entries."""
        gap = self.vectors[found] - query
        distance = np.sqrt((gap * gap).sum(axis=1))
        # an entry may be the query's own: look one further
        near = len(found)
        if near > nearest + 1:
            limit = np.partition(distance, nearest)[nearest]
            keep = distance <= limit
            found, distance = found[keep], distance[keep]
        pairs = [
            (d, i)
            for d, e in zip(distance.tolist(), found.tolist())
            for i in self.members[e].tolist()
            if i != own
        ]
        return sorted(pairs)[:nearest]


def _shards(batches):
    """Rows gathered to at most SHARD vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        for i, v in zip(batch["vec_id"], batch["embedding"]):
            rows = held.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) == SHARD:
                yield held.pop(len(v))
    yield from held.values()


def search_block(vectors: DataFrame, block, nearest: int, wanted: int) -> DataFrame:
    """Answers of one block of queries {length: (ids, vectors)} from every shard."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for rows in _shards(batches):
            size = len(rows[0][1])
            if size not in shared.value:
                continue
            ids, queries = shared.value[size]
            forest = Forest(np.array([r[0] for r in rows]), np.stack([r[1] for r in rows]), nearest)
            for at in range(0, len(ids), 512):
                out = []
                part = slice(at, at + 512)
                for q, found in enumerate(forest.search(queries[part], wanted), at):
                    for d, i in forest.nearest(int(ids[q]), queries[q], found, nearest):
                        out.append((int(ids[q]), i, d))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return vectors.mapInPandas(run, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, wanted: int = CANDIDATES
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each query."""
    vectors, queries = usable(vectors), usable(queries)
    blocks = max(1, -(-queries.count() // BLOCK))
    results = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block: dict[int, list] = {}
        for row in mine.toLocalIterator():
            block.setdefault(len(row[1]), []).append(row)
        packed = {
            size: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            for size, rows in block.items()
        }
        found = search_block(vectors, packed, nearest, wanted)
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
        results.append(stored(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
