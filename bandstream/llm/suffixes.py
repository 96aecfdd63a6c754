"""Repeated passages with a sparse suffix array (operator 8).

Of all suffixes of a text (as words, A-Z as a-z) only those are kept that start
at a minimiser: the smallest hash of ``GRAM`` words in some window of ``WINDOW``
such hashes.  Two equal passages choose the same places, about one word in nine.
A kept suffix is sorted by the hash of its first ``PREFIX`` words,
then by the words that follow; in the sorted array each one that agrees with its
neighbour is matched with it and with the first of its run.  A passage of
``SHORTEST`` words always contains a kept suffix whose prefix lies inside it
(``WINDOW - 1 + PREFIX <= SHORTEST``).

Anchors of two documents on one diagonal join to runs.  A run is verified by a
128-bit digest of its words and extended left and right word by word to where the
two texts differ: ``REACH`` words at first, and those that agree so far read on in
steps four times as long.

The array is range partitioned by prefix, document and place: a passage that a
third of all documents has is spread over many tasks.  Where a range border cuts
through equal prefixes, the pieces are linked afterwards by one row per border.

A row tells how far a document agrees with one earlier document; there may be
rows for several.

Passages repeated inside one document only are not reported.  Rows with the same
doc_id and text are one document.  Null and short texts have no passages.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandstream.llm.common import discard, fields, stored, table, text_bytes

GRAM = 5
WINDOW = 16
PREFIX = 32
SHORTEST = 50
#: Words per block of the order beyond the prefix.
BLOCK = 5
#: Words read on each side of a run at first.
REACH = 64
BASE = 0x9E3779B97F4A7C15
#: Hashes of words remembered by a worker, and the longest word among them.
WORDS_KNOWN, LONGEST_KNOWN = 200_000, 64
#: Bytes of context handed on at once.
CONTEXT_BYTES = 16 << 20


class WordHashes(dict):
    """Hash of a word, worked out once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KNOWN:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KNOWN:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd number modulo 2**64, as many as the longest text asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) <= n:
            steps = np.full(n + n // 4 + 1, self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps)
        return self.known[: n + 1]


UP, DOWN = Powers(BASE), Powers(pow(BASE, -1, 1 << 64))


class RunHashes:
    """Hashes of runs of words, each from the difference of two prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        terms = mixed(hashes) * DOWN.upto(self.n)[: self.n]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        """Runs of ``size`` words from ``places`` on; what is beyond the text counts as nothing."""
        ends = places + size
        inside = self.sums[np.minimum(ends, self.n)] - self.sums[np.minimum(places, self.n)]
        return mixed(inside * UP.upto(self.n + PREFIX + 4 * BLOCK)[ends])


def following(runs: RunHashes, places: np.ndarray) -> np.ndarray:
    """Sort key of what comes after the prefixes: 16 bits for each of four blocks."""
    out = np.zeros(len(places), dtype=np.uint64)
    for block in range(4):
        key = runs.at(places + PREFIX + block * BLOCK, BLOCK)
        out = (out << np.uint64(16)) | (key >> np.uint64(48))
    return out


def anchors(runs: RunHashes) -> np.ndarray:
    """Places of the kept suffixes."""
    if runs.n < PREFIX:
        return np.empty(0, dtype=np.int64)
    grams = runs.at(np.arange(runs.n - GRAM + 1), GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, min(WINDOW, len(grams)))
    places = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return places[places + PREFIX <= runs.n]


def suffix_rows(docs: DataFrame) -> DataFrame:
    """h, e, doc_id, k, pos of every kept suffix; e orders equal prefixes."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            rows, hashes, order, places = [], [], [], []
            for n, text in enumerate(texts.to_pylist()):
                own = RunHashes(known.of(text.lower().split()))
                at = anchors(own)
                rows.append(np.full(len(at), n))
                hashes.append(own.at(at, PREFIX))
                order.append(following(own, at))
                places.append(at)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes).view(np.int64)),
                    pa.array(np.concatenate(order).view(np.int64)),
                    ids.take(take),
                    keys.take(take),
                    pa.array(np.concatenate(places).astype(np.int32)),
                ],
                ["h", "e", "doc_id", "k", "pos"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "k", text_bytes().alias("raw"))
    return rows.mapInArrow(run, fields(f"h long, e long, doc_id {kind}, k long, pos int"))


def neighbour_pairs(suffixes: DataFrame) -> DataFrame:
    """h, doc_id, k, pos, to_id, to_k, to_pos: suffixes with their predecessor of equal prefix.

    ``opens``: the predecessor may have no pair of its own.
    """
    spark = suffixes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    names = ["h", "e", "doc_id", "k", "pos"]

    def compare(batches):
        """Rows arrive in order; each is compared with the one before."""
        before = first_row = None

        def out(rows, others, opens, border):
            left = [rows.column(c) for c in names]
            right = [others.column(c) for c in ("doc_id", "k", "pos")]
            return pa.RecordBatch.from_arrays(
                [*left, *right, pa.array(opens), pa.array(np.full(rows.num_rows, border))],
                [*names, "to_id", "to_k", "to_pos", "opens", "border"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if first_row is None:
                first_row = batch.slice(0, 1)
            else:
                batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            h = batch.column(0).to_numpy(zero_copy_only=False)
            same = np.flatnonzero(h[1:] == h[:-1])
            if len(same):
                opens = (same == 0) | (h[same] != h[same - 1])
                rows, others = batch.take(pa.array(same + 1)), batch.take(pa.array(same))
                yield out(rows, others, opens, False)
            before = batch.slice(batch.num_rows - 1, 1)
        if first_row is not None:
            for edge in (first_row, before):
                yield out(edge, edge, np.ones(1, dtype=bool), True)

    dealt = suffixes.repartitionByRange(n, *names).sortWithinPartitions(*names)
    side = f"doc_id {kind}, k long, pos int, to_id {kind}, to_k long, to_pos int"
    shape = fields(f"h long, e long, {side}, opens boolean, border boolean")
    compared = stored(dealt.mapInArrow(compare, shape), "neighbours")
    # the rows on both sides of a range border: at most two per partition
    line = Window.partitionBy("h").orderBy("e", "doc_id", "k", "pos")
    across = (
        compared.where("border")
        .select(*names)
        .distinct()
        .select(
            "h",
            "doc_id",
            "k",
            "pos",
            F.lag("doc_id").over(line).alias("to_id"),
            F.lag("k").over(line).alias("to_k"),
            F.lag("pos").over(line).alias("to_pos"),
            F.lit(True).alias("opens"),
        )
        .where("to_pos IS NOT NULL")
    )
    return compared.where("NOT border").drop("border", "e").unionByName(across)


def neighbour_links(pairs: DataFrame) -> DataFrame:
    """doc_id, k, pos, to_id, to_k, to_pos: a repeated suffix and an earlier one.

    Each is linked to the first document of its run (with equal prefixes) and to
    its neighbour in the array, which may agree further.
    """
    members = pairs.select("h", "doc_id", "k", "pos").unionByName(
        pairs.where("opens").select(
            "h", F.col("to_id").alias("doc_id"), F.col("to_k").alias("k"), F.col("to_pos").alias("pos")
        )
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "pos")
    # stored, so that the join has two plain shuffles and a hot prefix can be split
    firsts = stored(members.groupBy("h").agg(F.min(place).alias("first")), "firsts").hint("merge")
    to_first = members.join(firsts, "h").select(
        "doc_id",
        "k",
        "pos",
        F.col("first.doc_id").alias("to_id"),
        F.col("first.k").alias("to_k"),
        F.col("first.pos").alias("to_pos"),
    )
    links = to_first.unionByName(earlier_second(pairs.drop("h", "opens")))
    return links.where(~same_document()).distinct()


def earlier_second(links: DataFrame) -> DataFrame:
    """Each link from the later document (by doc_id, nulls last, then k) to the earlier."""
    doc, other = F.col("doc_id"), F.col("to_id")
    swap = (
        F.when(doc.isNull() & other.isNull(), F.col("k") < F.col("to_k"))
        .when(doc.isNull(), False)
        .when(other.isNull(), True)
        .otherwise((doc < other) | ((doc == other) & (F.col("k") < F.col("to_k"))))
    )
    sides = (("doc_id", "to_id"), ("k", "to_k"), ("pos", "to_pos"))
    here = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in sides]
    there = [F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in sides]
    return links.select(*here, *there)


def same_document():
    return F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("k") == F.col("to_k"))


RUN = ["doc_id", "k", "start", "end", "to_id", "to_k", "to_start", "to_end"]


def runs(links: DataFrame) -> DataFrame:
    """Anchors on one diagonal of two documents joined to runs of certain words."""
    pair = ["doc_id", "k", "to_id", "to_k", "diagonal"]
    rows = links.withColumn("diagonal", F.col("pos") - F.col("to_pos"))
    line = Window.partitionBy(*pair).orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(line)
    rows = rows.withColumn("new", F.coalesce(gap > PREFIX, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(line))
    return (
        rows.groupBy(*pair, "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + PREFIX).alias("end"))
        .select(
            "doc_id",
            "k",
            "start",
            "end",
            "to_id",
            "to_k",
            (F.col("start") - F.col("diagonal")).alias("to_start"),
            (F.col("end") - F.col("diagonal")).alias("to_end"),
        )
    )


def contexts(docs: DataFrame, found: DataFrame, reach: int = REACH) -> DataFrame:
    """For both sides of every run: digest of its words, hashes of ``reach`` words around.

    ``here``, ``there``: it is the later or the earlier side of some run, so that a join
    shuffles the contexts of its side only.
    """
    asked = (
        found.select("doc_id", "k", "start", "end", F.lit(True).alias("here"))
        .unionByName(
            found.select(
                F.col("to_id").alias("doc_id"),
                F.col("to_k").alias("k"),
                F.col("to_start").alias("start"),
                F.col("to_end").alias("end"),
                F.lit(False).alias("here"),
            )
        )
        .groupBy("doc_id", "k", "start", "end")
        .agg(F.max("here").alias("here"), F.max(~F.col("here")).alias("there"))
        .groupBy("doc_id", "k")
        .agg(F.collect_list(F.struct("start", "end", "here", "there")).alias("spans"))
        .withColumnsRenamed({"doc_id": "asked_id", "k": "asked_k"})
    )
    # stored, so that its size is known: the few runs that read on need no shuffle of all texts
    asked = stored(asked, "asked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "k", text_bytes().alias("raw"))
    rows = texts.join(
        asked,
        F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("k") == F.col("asked_k")),
    ).select("doc_id", "k", "raw", "spans")

    types = (None, pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3, *[pa.bool_()] * 2)
    names = ["c_id", "c_k", "c_start", "c_end", "digest", "left", "right", "here", "there"]

    def run(batches):
        known = WordHashes()
        for batch in batches:

            def packed(out):
                kinds = [t or batch.schema.field(0).type for t in types]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, names)

            out, size = [], 0
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc_id, k, text, spans in zip(*columns):
                words = text.lower().split()
                short = known.of(words).astype("<u4")  # the low 32 bits
                for span in spans:
                    a, b = span["start"], span["end"]
                    digest = xxhash.xxh3_128_digest(b" ".join(words[a:b]))
                    left = short[max(0, a - reach) : a][::-1].tobytes()
                    right = short[b : b + reach].tobytes()
                    sides = span["here"], span["there"]
                    out.append((doc_id, k, a, b, digest, left, right, *sides))
                    size += len(left) + len(right)
                    if size > CONTEXT_BYTES:
                        yield packed(out)
                        out, size = [], 0
            yield packed(out)

    return rows.mapInArrow(
        run,
        fields(
            f"c_id {kind}, c_k long, c_start int, c_end int, "
            "digest binary, left binary, right binary, here boolean, there boolean"
        ),
    )


def common_words(a: bytes, b: bytes) -> int:
    """How many leading 32-bit words agree."""
    n = min(len(a), len(b)) // 4
    x, y = np.frombuffer(a[: 4 * n], dtype="<u4"), np.frombuffer(b[: 4 * n], dtype="<u4")
    different = np.flatnonzero(x != y)
    return int(different[0]) if len(different) else n


def extended(docs: DataFrame, found: DataFrame, reach: int) -> DataFrame:
    """Runs whose words are equal, grown by up to ``reach`` words on each side.

    ``open``: both sides agree as far as they were read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    around = stored(contexts(docs, found, reach), "contexts")

    def seen(suffix, side, doc, k, start, end):
        mine = around.where(side).drop("here", "there")
        names = {c: f"{c}{suffix}" for c in mine.columns}
        mine = mine.withColumnsRenamed(names)
        on = (
            F.col(doc).eqNullSafe(F.col(names["c_id"]))
            & (F.col(k) == F.col(names["c_k"]))
            & (F.col(start) == F.col(names["c_start"]))
            & (F.col(end) == F.col(names["c_end"]))
        )
        return mine, on

    both = found.join(*seen("_a", "here", "doc_id", "k", "start", "end"))
    both = both.join(*seen("_b", "there", "to_id", "to_k", "to_start", "to_end"))
    both = both.where("digest_a = digest_b").select(
        *RUN, "left_a", "left_b", "right_a", "right_b"
    )

    def extend(batches):
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in range(8, 12)]
            before = np.array([common_words(a, b) for a, b in zip(*sides[:2])], dtype=np.int32)
            after = np.array([common_words(a, b) for a, b in zip(*sides[2:])], dtype=np.int32)
            start, end, to_start, to_end = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 6, 7)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in (0, 1)],
                    pa.array(start - before),
                    pa.array(end + after),
                    *[batch.column(i) for i in (4, 5)],
                    pa.array(to_start - before),
                    pa.array(to_end + after),
                    pa.array((before == reach) | (after == reach)),
                ],
                [*RUN, "open"],
            )

    shape = f"doc_id {kind}, k long, start int, end int, to_id {kind}, to_k long, to_start int"
    grown = both.mapInArrow(extend, fields(f"{shape}, to_end int, open boolean")).distinct()
    grown = stored(grown, "extended")
    discard(around)
    return grown


def once(docs: DataFrame) -> DataFrame:
    """doc_id, k, text: repeated rows only once; k tells apart documents of one doc_id.

    k is 0 where a doc_id has one text, which is as good as always: eight bytes a suffix
    that compress to nothing.  Only the rows of repeated ids are shuffled.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated.withColumnRenamed("doc_id", "again"), "repeated")
    here = F.col("doc_id").eqNullSafe(F.col("again"))
    several = docs.join(repeated, here, "left_semi")
    several = several.select("doc_id", F.xxhash64("text").alias("k"), "text")
    several = several.dropDuplicates(["doc_id", "k"])
    single = docs.join(repeated, here, "left_anti")
    return single.select("doc_id", F.lit(0).cast("long").alias("k"), "text").unionByName(several)


def repeated_passages(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, start, n_words, of_doc_id, of_start: passages that an earlier document has.

    ``shortest`` must be at least SHORTEST.  Scratch tables are deleted as soon as
    what was built from them is stored.
    """
    docs = once(docs.select("doc_id", "text").where("text IS NOT NULL"))
    # stored, because range partitioning reads its input twice
    suffixes = stored(suffix_rows(docs), "suffixes")
    pairs = neighbour_pairs(suffixes)
    discard(suffixes)  # the pairs are stored
    found = stored(runs(neighbour_links(pairs)), "runs")
    discard(pairs)
    closed, reach = [], REACH
    while True:
        grown = extended(docs, found, reach)
        discard(found)
        closed.append(grown.where("NOT open").drop("open"))
        found = grown.where("open").drop("open")
        if found.isEmpty():
            break
        found, reach = stored(found, "open"), 4 * reach
    length = F.col("end") - F.col("start")
    return (
        reduce(DataFrame.unionByName, closed)
        .where(length >= shortest)
        .select(
            "doc_id",
            "start",
            length.alias("n_words"),
            F.col("to_id").alias("of_doc_id"),
            F.col("to_start").alias("of_start"),
            "k",
            "to_k",
        )
        .distinct()
        .drop("k", "to_k")
    )


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
