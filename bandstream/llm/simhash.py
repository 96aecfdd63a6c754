"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 6).

Two fingerprints that differ in at most ``2 r`` bits have a common variant that
differs from either in at most ``r``.  Every distinct fingerprint emits all its
variants within ``r`` = 2; equal variants meet; whoever meets is linked.

2081 full variants per fingerprint would be 33 KB in a shuffle, so what is
shuffled is the leading bits of the variants: each fingerprint is sent once to
every *cell* (value of the leading ``b`` bits) that one of its variants has, and
the variants of that cell are spelled out there, sorted and compared.  ``b``
follows from the number of fingerprints, so cells keep their size.

Everyone who meets at a variant is linked to the smallest one there: all of
them lie within ``2 r`` of each other, hence the same components come out as
from all pairs.  Inside a cell the links are reduced to a spanning forest.

Copies are collapsed first (one row per fingerprint).  Null and empty texts have
fingerprint zero and are linked like any other.  Repeated rows stay repeated in
the result.  A null doc_id never names a component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import doc_key, fields, fresh, stored, table, text_bytes
from bandstream.llm.graph import components

SEED = 42
WORDS = 4
RADIUS = 2
#: Fingerprints sent to a cell, on average, at most.
CELL_ROWS = 8192
#: Variants spelled out at once; more are done in several passes.
AT_ONCE = 2_000_000


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of the word shingles of a text; A-Z count as a-z."""
    parts = text.lower().split()
    if len(parts) <= words:
        found = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.concatenate([[0], ends[:-words]])
        digest = xxhash.xxh64_intdigest
        found = [
            digest(line[s:e], SEED)
            for s, e in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())
        ]
    return np.array(found, dtype=np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in more than half of the shingle hashes."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        piece = hashes[at : at + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(piece, axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    above = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(above, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp``, a signed long."""
    (raw,) = fresh(docs, "raw")
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64)
            columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "fp"])

    schema = fields("")
    for field in docs.select(*rest).schema:
        schema.add(field)
    schema.add("fp", "long")
    return docs.select(*rest, text_bytes(text).alias(raw)).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def flips(bits: int, most: int) -> np.ndarray:
    """Masks of at most ``most`` (0 to 2) of the lowest ``bits`` bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    masks = [np.zeros(1, dtype=np.uint64)]
    if most >= 1:
        masks.append(one)
    if most >= 2:
        i, j = np.triu_indices(bits, 1)
        masks.append(one[i] | one[j])
    return np.concatenate(masks)


def cell_bits(n: int, target: int = CELL_ROWS) -> int:
    """Leading bits for cells of at most about ``target`` rows, in steps of four.

    More bits mean more rows per fingerprint; in steps, the rows per fingerprint
    stay the same over a 30-fold range of sizes.
    """
    for bits in range(12, 32, 4):
        if n * len(flips(bits, RADIUS)) <= target << bits:
            return bits
    return 32


def meet(cells: np.ndarray, prints: np.ndarray, bits: int, at_once: int = AT_ONCE):
    """Links (larger, smaller) between fingerprints that meet in whole cells."""
    low = np.uint64(64 - bits)
    base = (cells << low) | (prints & ((np.uint64(1) << low) - np.uint64(1)))
    used = np.bitwise_count((prints >> low) ^ cells)
    sizes = [len(flips(64 - bits, RADIUS - u)) for u in range(RADIUS + 1)]
    total = sum(int((used == u).sum()) * sizes[u] for u in range(RADIUS + 1))
    passes = -(-total // at_once)
    links = []
    for k in range(passes):
        variants, owners = [], []
        for u in range(RADIUS + 1):
            rows = np.flatnonzero(used == u)
            masks = flips(64 - bits, RADIUS - u)
            for piece in np.array_split(rows, max(1, len(rows) * len(masks) // at_once + 1)):
                made = (base[piece][:, None] ^ masks).reshape(-1)
                whose = np.repeat(piece, len(masks))
                if passes > 1:
                    here = made % np.uint64(passes) == np.uint64(k)
                    made, whose = made[here], whose[here]
                variants.append(made)
                owners.append(whose)
        made, whose = np.concatenate(variants), prints[np.concatenate(owners)]
        order = np.argsort(made, kind="stable")
        made, whose = made[order], whose[order]
        new = np.concatenate([[True], made[1:] != made[:-1]])
        starts = np.flatnonzero(new)
        if len(starts) == len(made):
            continue
        least = np.minimum.reduceat(whose, starts)[np.cumsum(new) - 1]
        other = whose != least
        links.append(np.unique(np.stack([whose[other], least[other]], axis=1), axis=0))
    if not links:
        return np.empty((0, 2), dtype=np.uint64)
    pairs = np.unique(np.concatenate(links), axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * RADIUS]


def forest(pairs: np.ndarray) -> np.ndarray:
    """As few of the links as keep the same components."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, dtype=np.uint64).reshape(-1, 2)


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Links (kind, u, v) between the distinct fingerprints ``fp`` of each ``kind``."""
    low = np.uint64(64 - bits)
    heads = flips(bits, RADIUS)
    shift = np.uint64(32)

    def scatter(batches):
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            own = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cells = (((own >> low)[:, None] ^ heads) | (kind << shift)[:, None]).reshape(-1)
            sent = np.repeat(own, len(heads))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.view(np.int64)), pa.array(sent.view(np.int64))], ["cell", "fp"]
            )

    def solve(cells, prints):
        for kind in np.unique(cells >> shift):
            own = (cells >> shift) == kind
            within = cells[own] & ((np.uint64(1) << shift) - np.uint64(1))
            pairs = forest(meet(within, prints[own], bits))
            columns = [pairs[:, i].copy().view(np.int64) for i in (0, 1)]
            kinds = np.full(len(pairs), kind, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (kinds, *columns)], ["kind", "u", "v"]
            )

    def gather(batches):
        """Rows arrive sorted by cell; whole cells are handed to :func:`meet`."""
        cells, prints = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in batches:
            new = [
                batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)
            ]
            cells, prints = np.concatenate([cells, new[0]]), np.concatenate([prints, new[1]])
            if len(cells) >= 30_000 and cells[0] != cells[-1]:
                end = np.searchsorted(cells, cells[-1])
                yield from solve(cells[:end], prints[:end])
                cells, prints = cells[end:], prints[end:]
        if len(cells):
            yield from solve(cells, prints)

    sent = prints.select("kind", "fp").mapInArrow(scatter, "cell long, fp long")
    dealt = sent.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(gather, "kind int, u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    marked = stored(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    only = first.select(F.lit(0).alias("kind"), "fp")
    roots = components(links(only, cell_bits(first.count())).drop("kind"))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- the pipeline's stage ----------------------------------------------------
#
# The first candidates are operator 6's: shingle sets whose 64-bit SimHashes meet in a
# ball.  Five-word shingles at a Jaccard similarity of 0.8 differ in about 10 of 64
# bits, which no ball of radius 2 can bridge.  What the balls cannot reach is found by
# min-wise selected shingles: whatever the edit is (scattered words, a cut end, an
# added paragraph), a minimum is shared with probability equal to the similarity.

STAGE_WORDS = 5
#: Keys of a document and minima in each.  A pair at similarity J shares a key with
#: probability 1 - (1 - J**ROWS)**BANDS: 0.9998 at 0.8, 0.9992 at 0.78.
BANDS, ROWS = 16, 4
SKETCH_WORDS = 4
#: Most different bits of two sketches in the rounds against heads: at Jaccard 0.8 the
#: mean is 39 (48 for texts of five shingles) and the deviation 6.  The last round does
#: without sketches.
SKETCH_BITS = 74
#: Rounds against a head, and shingles of a block when all sets of a key are compared.
TURNS, BLOCK = 2, 500_000


def stirred(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes as different ones, by the finalizer of MurmurHash3."""
    h = hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


SALTS = stirred(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 99)


def weighted_print(hashes: np.ndarray, weights: np.ndarray) -> int:
    ones = np.zeros(64)
    for at in range(0, len(hashes), 16_384):
        piece = hashes[at : at + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += weights[at : at + 16_384] @ np.unpackbits(piece, axis=1, bitorder="little")
    above = (2 * ones > weights.sum()).astype(np.uint8)
    return int(np.packbits(above, bitorder="little").view("<u8")[0])


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct five-word shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text, STAGE_WORDS))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its ``ROWS`` min-wise selected shingles."""
    least = np.full(len(SALTS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        mixed = stirred(shingles[at : at + 1024, None] ^ SALTS, 0)
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = stirred(keys, 5) ^ column
    return stirred(keys, 6)


def profile(text: bytes) -> tuple[int, np.ndarray, list[int]]:
    """A name for the shingle set, its band keys and its SimHash sketch."""
    shingles = shingle_set(text)
    even = np.ones(len(shingles))
    sketch = [weighted_print(stirred(shingles, 16 + k), even) for k in range(SKETCH_WORDS)]
    name = xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), SEED)
    return name, band_keys(shingles), sketch


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, the two keys of the row, node (its shingle set), band keys, sketch s0.."""
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]

    def run(batches):
        for batch in batches:
            made = [profile(t) for t in batch.column(3).to_pylist()]
            longs = np.array([[m[0], *m[2]] for m in made], dtype=np.uint64)
            longs = longs.reshape(-1, 1 + SKETCH_WORDS).view(np.int64)
            keys = np.array([m[1] for m in made], dtype=np.uint64).reshape(-1).view(np.int64)
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * BANDS)
            node, *prints = (pa.array(longs[:, k].copy()) for k in range(1 + SKETCH_WORDS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], node, pa.ListArray.from_arrays(ends, pa.array(keys)), *prints],
                ["doc_id", "k1", "k2", "node", "keys", *sketch],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    k1, k2 = doc_key("doc_id", "text")
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), text_bytes().alias("raw"))
    ddl = ", ".join(f"{s} long" for s in sketch)
    return rows.mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, node long, keys array<long>, {ddl}"
    )


def different_bits(a: str, b: str):
    """Hamming distance of two sketches in columns with prefixes ``a`` and ``b``."""
    parts = [
        F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(SKETCH_WORDS)
    ]
    return sum(parts[1:], parts[0])


def ball_pairs(same: DataFrame) -> DataFrame:
    """(u, v): shingle sets whose SimHashes ``s0`` operator 6 links, still to be compared.

    Sets of one fingerprint meet at the smallest; as in the operator, a cell gives as
    few links as keep its components.  Of its links a set brings the one with the
    fewest different bits, so that a large group costs no more than its rows; what is
    left out shares keys and is compared in the later rounds.
    """
    first = stored(same.groupBy("s0").agg(F.min("node").alias("head")), "distinct")
    only = first.select(F.lit(0).alias("kind"), F.col("s0").alias("fp"))
    met = links(only, cell_bits(first.count()))
    for side in "uv":
        heads = first.select(F.col("s0").alias(side), F.col("head").alias(f"node_{side}"))
        met = met.join(heads, side)
    bits = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("bits")
    met = met.select(F.col("node_u").alias("u"), F.struct(bits, F.col("node_v").alias("v")).alias("p"))
    own = same.join(first, "s0").where("node != head").select(
        F.col("node").alias("u"), F.struct(F.lit(0).alias("bits"), F.col("head").alias("v")).alias("p")
    )
    best = met.unionByName(own).groupBy("u").agg(F.min("p").alias("p"))
    return best.select("u", F.col("p.v").alias("v"))


def meetings(same: DataFrame) -> DataFrame:
    """(key, node, s0..) for the keys that several shingle sets have."""
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    rows = same.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    return rows.join(shared, "key").join(same.select("node", *sketch), "node")


def shingle_sets(docs: DataFrame, same: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): the whole shingle sets of ``nodes``."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                ["node", "shingles"],
            )

    k1, k2 = doc_key("doc_id", "text")
    first = same.join(nodes, "node", "left_semi").select("node", "first.k1", "first.k2")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text_bytes().alias("raw"))
    found = texts.join(first, ["k1", "k2"]).select("node", "raw")
    return found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose five-word Jaccard similarity is 0.8 or more, exactly.

    common / (a + b - common) >= 4 / 5 in whole numbers.
    """
    for side in "uv":
        pairs = pairs.join(
            sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")), side
        )
    common = F.size(F.array_intersect("of_u", "of_v"))
    return pairs.where(9 * common >= 4 * (F.size("of_u") + F.size("of_v"))).select("u", "v")


def star_pairs(meeting: DataFrame, turn: int) -> DataFrame:
    """(u, v): each set with the closest of the heads of its keys.

    Every turn draws other heads; only heads of another component count.
    """
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "root", *sketch)
    heads = meeting.groupBy("key").agg(F.min(drawn).alias("h"))
    heads = heads.select(
        "key",
        F.col("h.node").alias("v"),
        F.col("h.root").alias("of"),
        *[F.col(f"h.{s}").alias(f"v{s}") for s in sketch],
    )
    bits = different_bits("s", "vs")
    close = meeting.join(heads, "key").where((F.col("root") != F.col("of")) & (bits <= SKETCH_BITS))
    best = close.groupBy("node").agg(F.min(F.struct(bits.alias("bits"), "v")).alias("best"))
    return best.select(F.col("node").alias("u"), F.col("best.v").alias("v"))


def forest_of_sets(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list:
    """Links (u, v) at 0.8 or more that join different components, as few as needed."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(places, kind="stable")]
    counts = np.bincount(places)
    starts = np.cumsum(counts) - counts
    label, found = np.unique(roots, return_inverse=True)[1], []
    for i in range(len(sets)):
        mine = places[ends[i] - sizes[i] : ends[i]]
        many = counts[mine]
        offsets = np.repeat(starts[mine] - (np.cumsum(many) - many), many)
        common = np.bincount(holders[offsets + np.arange(len(offsets))], minlength=len(sets))
        alike = 9 * common >= 4 * (sizes + sizes[i])
        while len(other := np.flatnonzero(alike & (label != label[i]))):
            found.append((int(nodes[i]), int(nodes[other[0]])))
            label[label == label[other[0]]] = label[i]
    return found


def all_links(meeting: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (u, v) after comparing all sets that share a key, whatever their number.

    Keys that the same sets have are one.  The sets of a key are compared inside
    squares of blocks of about ``block`` shingles, so that every task is bounded;
    only links that hold and are needed leave a square.
    """
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("m")]
    sized = meeting.join(sets, "node").withColumn("size", F.size("shingles"))
    keys = sized.groupBy("key").agg(*same, F.ceil(F.sum("size") / block).cast("long").alias("parts"))
    keys = keys.groupBy("n", "x", "m").agg(F.min(F.struct("key", "parts")).alias("k")).select("k.*")
    rows = sized.join(keys, "key").select(
        "key",
        F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)).alias("x"),
        "node",
        "root",
        "shingles",
    )
    squares = rows.withColumns({"a": F.least("own", "x"), "b": F.greatest("own", "x")})

    def solve(group: pa.Table) -> pa.Table:
        nodes, roots = (group[c].to_numpy() for c in ("node", "root"))
        sets = [s.values.to_numpy(zero_copy_only=False) for s in group["shingles"]]
        found = np.array(forest_of_sets(nodes, roots, sets), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0].copy(), "v": found[:, 1].copy()})

    return squares.groupBy("key", "a", "b").applyInArrow(solve, "u long, v long").distinct()


def linked(docs: DataFrame, same: DataFrame, balls: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that give the components of all pairs at 0.8 or more.

    A pair is left out only when verified links already connect its two sides:
    the pairs ``balls`` and ``TURNS`` cheap rounds against a head join what is alike,
    and the last round compares all that share a key with a member of another
    component.
    """
    meeting = stored(meetings(same), "meeting")
    nodes = meeting.select("node")
    if balls is not None:
        nodes = nodes.union(balls.select("u")).union(balls.select("v"))
    sets = stored(shingle_sets(docs, same, nodes.distinct()), "shingles")
    left = meeting.withColumn("root", F.col("node"))
    links = None
    for turn in range(-1 if balls is not None else 0, TURNS + 1):
        if turn < 0:
            found = alike(balls, sets)
        elif turn < TURNS:
            found = alike(star_pairs(left, turn), sets)
        else:
            found = all_links(left, sets, BLOCK)
        found = stored(found, "links")
        links = found if links is None else links.unionByName(found)
        if turn == TURNS:
            break
        rooted = meeting.join(components(links), "node", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "node"))
        ends = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"))
        left = stored(rooted.join(ends.where("a != b").select("key"), "key"), "meeting")
        if left.isEmpty():
            break
    return links


def keepers(docs: DataFrame) -> DataFrame:
    """(k1, k2, copies): one document of every group of near duplicates.

    The smallest doc_id stays (a null one only if there is no other); among
    equal ones the smaller key.  ``copies`` counts equal rows of that document.
    """
    marked = stored(profiles(docs), "profiles")
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    same = stored(
        marked.groupBy("node").agg(
            F.min(own).alias("first"), *[F.first(c).alias(c) for c in ("keys", *sketch)]
        ),
        "classes",
    )
    roots = components(linked(docs, same, stored(ball_pairs(same), "balls")))
    grouped = same.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    return (
        marked.join(kept, ["k1", "k2"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.count("*").alias("copies"))
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one document stays, the smallest doc_id.

    Of equal rows one stays.  Texts without words are duplicates of each other.
    """
    k1, k2, copies = fresh(docs, "k1", "k2", "copies")
    one, two = doc_key("doc_id", "text")
    kept = stored(keepers(docs), "keepers").toDF(k1, k2, copies)
    found = docs.withColumns({k1: one, k2: two}).join(kept, [k1, k2])
    single = found.where(F.col(copies) == 1)
    again = found.where(F.col(copies) > 1).dropDuplicates([k1, k2])
    return single.unionByName(again).select(*docs.columns)
