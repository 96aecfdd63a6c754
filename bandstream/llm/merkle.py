"""Merkle manifest of a dataset with resumable hash states (operator 12).

A row is a leaf: the SHA-256 of its fields.  The leaves of a part (a source) form
a tree in which every ``FANOUT`` consecutive nodes have a parent, the hash of
their hexadecimal digests one after the other; the roots of the parts form a tree
of the same kind.

A hexadecimal digest is exactly one 64-byte block of SHA-256.  So the state of a
parent's hash before each child slot is eight words with nothing pending, and the
parent keeps a copy of it per slot.  Folding a replaced child resumes the state of
its slot with the new digest and the siblings on its right; what lies to the left
is never hashed again.  The digest of a proof is carried up in the same way.  The
compression function runs in numpy over all nodes of a level at once.

Rows are numbered by (part, key) with a range partitioned sort.  A block of
consecutive nodes builds ``LEVELS`` levels in one task, its top is a node
of the next pass, so the number of passes is a small logarithm.  Blocks are stored
with their digests and states; paths to the root travel down block by block, and
only then are the leaves of each block folded.  No group is larger than a block,
whatever a part's share.

Null fields hash as ``-``; a null part is a part of its own and comes first; null
keys come first, and equal keys are ordered by their leaves.  A part of one row is
its own root; a tree of one part has that part's root as its own.  A proof without
siblings is the hash of nothing.  An empty table has no rows and no root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import fields, stored, table
from bandstream.operators.runs import number_rows

FANOUT = 3
#: Levels that a block builds; it has up to FANOUT ** LEVELS leaves.
LEVELS = 6
#: Columns hashed at once, so that a message schedule stays in cache.
LANES = 4096

# --- SHA-256 over arrays: states are (8, n), blocks (16, n), of unsigned 32-bit words


def _roots(power: int, n: int) -> list[int]:
    """First 32 fraction bits of the roots of the first ``n`` primes."""
    out, p = [], 2
    while len(out) < n:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            scaled, low, high = p << (32 * power), 0, 1 << 40
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if middle**power <= scaled else (low, middle)
            out.append(low & 0xFFFFFFFF)
        p += 1
    return out


START = np.array(_roots(2, 8), dtype=np.uint32)[:, None]
ROUND = np.array(_roots(3, 64), dtype=np.uint32)
#: Four hexadecimal characters of 16 bits, as a big-endian word.
HEX4 = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), dtype=">u4").astype(
    np.uint32
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _lanes(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = np.empty((64, state.shape[1]), dtype=np.uint32)
    w[:16] = block
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        s0 = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        s1 = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w[t] = w[t - 16] + s0 + w[t - 7] + s1
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g)))
        first = first + ROUND[t] + w[t]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block each."""
    n = state.shape[1]
    if n <= LANES:
        return _lanes(state, block)
    out = np.empty_like(state)
    for at in range(0, n, LANES):
        part = slice(at, at + LANES)
        out[:, part] = _lanes(state[:, part], block[:, part])
    return out


def as_hex(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the block of their hexadecimal characters."""
    out = np.empty((16, digest.shape[1]), dtype=np.uint32)
    out[0::2] = HEX4[digest >> np.uint32(16)]
    out[1::2] = HEX4[digest & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages of ``blocks`` whole blocks with these states."""
    pad = np.zeros((16, state.shape[1]), dtype=np.uint32)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[0] = 0x80000000
    pad[14] = (bits >> np.uint64(32)).astype(np.uint32)
    pad[15] = (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return absorb(state, pad)


def where(state: np.ndarray, block: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``absorb`` for the columns in ``mask`` alone."""
    if mask.all():
        return absorb(state, block)
    out = state.copy()
    if mask.any():
        out[:, mask] = absorb(state[:, mask], block[:, mask])
    return out


def starts(n: int) -> np.ndarray:
    return np.repeat(START, n, axis=1)


def words(data: bytes) -> np.ndarray:
    """Digests one after the other as (8, n)."""
    return np.frombuffer(data, dtype=">u4").astype(np.uint32).reshape(-1, 8).T


def raw(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def texts(digests: np.ndarray) -> list[str]:
    data = raw(digests).hex()
    return [data[at : at + 64] for at in range(0, len(data), 64)]


# --- blocks of trees


def shape(nodes: int, levels: int) -> list[int]:
    """Nodes per level, from the leaves up."""
    out = [nodes]
    for _ in range(levels):
        out.append(-(-out[-1] // FANOUT))
    return out


def height(nodes: int) -> int:
    """Levels until one node is left."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // FANOUT), out + 1
    return out


def build(leaves: list[bytes], levels: list[int]) -> list[tuple[bytes, bytes]]:
    """Per block, from its leaf digests: the digests above them and the kept states.

    All blocks rise together, a level at a time.
    """
    above, kept = [[] for _ in leaves], [[] for _ in leaves]
    nodes, size = words(b"".join(leaves)), np.array([len(x) // 32 for x in leaves])
    block, levels = np.arange(len(leaves)), np.array(levels)
    for level in range(max(levels, default=0)):
        has = levels[block] > level
        nodes, block, size = nodes[:, np.repeat(has, size)], block[has], size[has]
        parents = -(-size // FANOUT)
        ends = np.cumsum(parents)
        number = np.arange(ends[-1]) - np.repeat(ends - parents, parents)
        first = np.repeat(np.cumsum(size) - size, parents) + FANOUT * number
        count = np.minimum(FANOUT, np.repeat(size, parents) - FANOUT * number)
        state, states = starts(len(first)), []
        for slot in range(FANOUT):
            states.append(state)
            child = np.minimum(first + slot, nodes.shape[1] - 1)
            state = where(state, as_hex(nodes[:, child]), count > slot)
        nodes, size = finish(state, count), parents
        states = np.stack(states, axis=2).reshape(8, -1)
        for b, end, n in zip(block, ends, parents):
            above[b].append(raw(nodes[:, end - n : end]))
            kept[b].append(raw(states[:, FANOUT * (end - n) : FANOUT * end]))
    return [(b"".join(a), b"".join(k)) for a, k in zip(above, kept)]


class Steps:
    """One level up for some leaves: kept state of the slot, run, slot, length of the run."""

    def __init__(self, kept, run, slot, count):
        self.kept, self.run, self.slot, self.count = kept, run, slot, count


def inside(leaves: bytes, nodes: bytes, states: bytes, levels: int) -> list[Steps]:
    """The levels of a block for all of its leaves."""
    sizes = shape(len(leaves) // 32, levels)
    ends = np.cumsum(sizes)
    all_, kept = words(leaves + nodes), words(states).reshape(8, -1, FANOUT)
    index, out, at = np.arange(sizes[0]), [], 0
    for level in range(levels):
        parent, slot = index // FANOUT, index % FANOUT
        count = np.minimum(FANOUT, sizes[level] - FANOUT * parent)
        run = FANOUT * parent + np.minimum(np.arange(FANOUT)[:, None], count - 1)
        run = all_[:, ends[level] - sizes[level] + run]
        out.append(Steps(kept[:, at + parent, slot], run, slot, count))
        index, at = parent, at + sizes[level + 1]
    return out


def beyond(kept: bytes, runs: bytes, slots: bytes, counts: bytes, n: int) -> list[Steps]:
    """The levels of a stored path, the same for ``n`` leaves."""
    kept, runs = words(kept), words(runs).reshape(8, -1, FANOUT)
    return [
        Steps(
            np.repeat(kept[:, k : k + 1], n, axis=1),
            np.repeat(runs[:, k, :, None], n, axis=2),
            np.full(n, slots[k]),
            np.full(n, counts[k]),
        )
        for k in range(len(slots))
    ]


def climb(digest: np.ndarray, ways: list[list[Steps]], sizes: list[int]):
    """Fold ``digest`` (the leaves of several blocks) to the root; also the proofs' digests."""
    digest, proof = digest.copy(), starts(digest.shape[1])
    length = np.zeros(digest.shape[1], dtype=np.int64)
    ends = np.cumsum(sizes)
    for level in range(max(map(len, ways), default=0)):
        here = [b for b, way in enumerate(ways) if len(way) > level]
        at = np.concatenate([np.arange(ends[b] - sizes[b], ends[b]) for b in here])
        steps = [ways[b][level] for b in here]
        state = np.concatenate([s.kept for s in steps], axis=1)
        run = np.concatenate([s.run for s in steps], axis=2)
        slot = np.concatenate([s.slot for s in steps])
        count = np.concatenate([s.count for s in steps])
        state, told = absorb(state, as_hex(digest[:, at])), proof[:, at]
        for other in range(FANOUT):
            there = (other < count) & (other != slot)
            block = as_hex(run[:, other])
            told = where(told, block, there)
            state = where(state, block, there & (other > slot))
        digest[:, at], proof[:, at] = finish(state, count), told
        length[at] += count - 1
    return digest, finish(proof, length)


# --- tables

NODE = "tree bigint, place bigint, total bigint, key bigint, digest binary, replaced binary"
#: A block: its tree and place, the nodes its tree has on this pass, and what it keeps.
BLOCK = """
    tree bigint, place bigint, total bigint, levels int, top binary,
    keys array<bigint>, leaves binary, replaced array<binary>, nodes binary, states binary
"""
#: The way from a node to the root: per level the kept state, the run, slot and run length.
PATH = """
    tree bigint, place bigint, part_root binary, root binary,
    kept binary, runs binary, slots binary, counts binary
"""
RESULT = """
    doc_id bigint, leaf string, subroot string, root string, proof_sha256 string,
    folded_root string, verified boolean
"""
KINDS = {
    "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(),
    "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    "array<binary>": pa.list_(pa.binary()),
}


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    pairs = [part.split() for part in ddl.split(",")]
    columns = zip(*rows) if rows else [()] * len(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, pairs)],
        [name for name, _ in pairs],
    )


def _built(most: int):
    def run(batches):
        for batch in batches:
            rows, out = batch.to_pylist(), []
            levels = [min(height(r["total"]), most) for r in rows]
            own = [b"".join([n["digest"] for n in r["nodes"]]) for r in rows]
            for r, depth, leaves, (nodes, states) in zip(rows, levels, own, build(own, levels)):
                keys = [n["key"] for n in r["nodes"]]
                replaced = [n["replaced"] for n in r["nodes"]]
                place = (r["tree"], r["place"], r["total"], depth, (nodes or leaves)[-32:])
                out.append((*place, keys, leaves, replaced, nodes, states))
            yield _batch(BLOCK, out)

    return run


def _ways(rows: list[dict]):
    """Per block its levels and those above it."""
    for r in rows:
        n = len(r["keys"])
        yield (
            inside(r["leaves"], r["nodes"], r["states"], r["levels"]),
            beyond(r["kept"], r["runs"], r["slots"], r["counts"], n),
        )


def _descended(of_parts: bool, width: int):
    def run(batches):
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for r, (own, _) in zip(rows, _ways(rows)):
                for k, key in enumerate(r["keys"]):
                    kept = b"".join([raw(s.kept[:, k : k + 1]) for s in own]) + r["kept"]
                    runs = b"".join([raw(s.run[:, :, k]) for s in own]) + r["runs"]
                    slots = bytes([int(s.slot[k]) for s in own]) + r["slots"]
                    counts = bytes([int(s.count[k]) for s in own]) + r["counts"]
                    where_ = (key, 0) if of_parts else (r["tree"], r["place"] * width + k)
                    part_root = r["leaves"][32 * k : 32 * k + 32] if of_parts else r["part_root"]
                    out.append((*where_, part_root, r["root"], kept, runs, slots, counts))
            yield _batch(PATH, out)

    return run


def _folded(batches):
    for batch in batches:
        rows = batch.to_pylist()
        while rows:
            here, n = [], 0
            while rows and n < 8 * LANES:
                here.append(rows.pop())
                n += len(here[-1]["keys"])
            sizes = [len(r["keys"]) for r in here]
            leaves = words(b"".join([r["leaves"] for r in here]))
            changed = words(
                b"".join(
                    new or r["leaves"][32 * k : 32 * k + 32]
                    for r in here
                    for k, new in enumerate(r["replaced"])
                )
            )
            folded, proof = climb(changed, [a + b for a, b in _ways(here)], sizes)
            of = lambda name: [r[name].hex() for r in here for _ in r["keys"]]
            roots, folded = of("root"), texts(folded)
            yield _batch(
                RESULT,
                list(zip(
                    [k for r in here for k in r["keys"]], texts(leaves), of("part_root"), roots,
                    texts(proof), folded, [a == b for a, b in zip(folded, roots)],
                )),
            )


def passes(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """Blocks of all trees, a pass of ``levels`` levels at a time; no tree has over ``most`` nodes."""
    out, width = [], FANOUT**levels
    while True:
        node = F.struct("place", "key", "digest", "replaced")
        blocks = (
            nodes.groupBy("tree", F.expr(f"place div {width}").alias("at"))
            .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(node)).alias("nodes"))
            .withColumnRenamed("at", "place")
        )
        out.append(stored(blocks.mapInArrow(_built(levels), fields(BLOCK)), "blocks"))
        if most <= width:
            return out
        most = -(-most // width)
        nodes = out[-1].select(
            "tree", "place", F.expr(f"(total + {width - 1}) div {width}").alias("total"),
            F.col("place").alias("key"), F.col("top").alias("digest"),
            F.lit(None).cast("binary").alias("replaced"),
        )


def descend(
    blocks: DataFrame, paths: DataFrame, levels: int, of_parts: bool = False
) -> DataFrame:
    below = _descended(of_parts, FANOUT**levels)
    return blocks.join(paths, ["tree", "place"]).mapInArrow(below, fields(PATH))


def hashed(*columns: str) -> Column:
    """SHA-256 of columns as UTF-8 byte count, colon and value each; null is ``-``."""
    one = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    parts = [F.coalesce(one(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def verified(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (part, key, digest, replaced) with their roots, proofs and folded roots.

    ``replaced`` is the digest to fold in place of ``digest``; null folds the leaf itself.
    """
    order = F.struct("part", "key", "digest", "replaced")
    rows = number_rows(leaves.withColumn("order", order), "order").drop("order")
    rows = stored(rows, "numbered")
    parts = stored(
        rows.groupBy("part").agg(F.min("position").alias("tree"), F.count("*").alias("total")), "parts"
    )
    most, n_parts = parts.agg(F.max("total"), F.count("*")).first()
    nodes = rows.join(parts, rows["part"].eqNullSafe(parts["part"])).select(
        "tree", (F.col("position") - F.col("tree")).alias("place"), "total", "key", "digest", "replaced"
    )
    below = passes(nodes, most or 0, levels)
    ranked = number_rows(below[-1].select("tree", "top"), "tree")
    tops = ranked.select(
        F.lit(-1).cast("long").alias("tree"), F.col("position").alias("place"),
        F.lit(n_parts).cast("long").alias("total"), F.col("tree").alias("key"),
        F.col("top").alias("digest"), F.lit(None).cast("binary").alias("replaced"),
    )
    above = passes(tops, n_parts, levels)
    none = F.lit(b"")
    paths = above[-1].select(
        "tree", "place", none.alias("part_root"), F.col("top").alias("root"),
        none.alias("kept"), none.alias("runs"), none.alias("slots"), none.alias("counts"),
    )
    for blocks in reversed(above[1:]):
        paths = descend(blocks, paths, levels)
    paths = descend(above[0], paths, levels, of_parts=True)
    for blocks in reversed(below[1:]):
        paths = descend(blocks, paths, levels)
    return below[0].join(paths, ["tree", "place"]).mapInArrow(_folded, fields(RESULT))


def leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents; every second one by CRC-32 of its id loses its line breaks."""
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    own = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = docs.select(*own).withColumn("cut", F.replace("text", F.lit("\n"), F.lit("")))
    return cut.select(
        F.col("source").alias("part"), F.col("doc_id").cast("long").alias("key"),
        hashed(*own).alias("digest"), F.when(tampered, hashed(*own[:-1], "cut")).alias("replaced"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(leaves(table(spark, sf_dir, "documents")))
