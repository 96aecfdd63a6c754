"""Best-fit packing of token sequences (operator 13).

Bounded-space online best-fit: a packer holds a fixed number of open bins, filed
by free space; a bitset has one bit per amount of free space that some open bin
has.  A piece goes to the bin with the least free space that still takes it, the
lowest set bit at or above its length.  If none takes it a new bin is opened, and
if that is one too many the fullest closes first.

Pieces are dealt to packers by a hash, about ``TASK_PIECES`` each, and packed in
hash order, which mixes the lengths.  Pieces in bins that are still open at the
end go to the next round, where they are some per cent of what the round had, and
so on until one packer is enough (each round has at most half the packers of the
one before); its open bins are the last.  Every round is stored, so that numbers stay what they are when a task runs again.

Words between white space are independent for the tokenizer, and so are their runs
of letters, digits and other characters where lower case and composition are plain.
Several megabytes of text are cut into such parts by arrays; each worker encodes a
part once with the library, many in one line, and remembers it.

Null texts are empty texts: one piece with the end token alone.  Equal rows are
packed as rows of their own.  Documents without an id keep a null id.  No row of
an empty table gives no sequence.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import fields, stored, table, text_bytes

SIZE = 4096
END = 1
#: Open bins of a packer.
OPEN_BINS = 1024
#: Pieces dealt to a packer.
TASK_PIECES = 100_000
#: Parts remembered, and their bytes; beyond either only those of the last chunk stay.
CACHE_WORDS = 700_000
CACHE_BYTES = 32 << 20
#: Bytes of text cut and looked up at once.
CHUNK_BYTES = 4 << 20
#: Parts encoded in one line.
LINE_PARTS = 200
#: Texts or lines handed to the library at once.
LIBRARY_TEXTS = 500

SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
#: What a byte is.  ``HARD`` ones leave their word to the library as it stands.
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[[*b" \t\n\v\f\r"]] = SPACE
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = LETTER
KINDS[[*b"0123456789"]] = DIGIT
KINDS[[ord("'"), *range(0x80, 0x100)]] = HARD
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)

#: Parts that are no hard words: these are one token sequence each, wherever they stand.
PLAIN = re.compile(r"(?:(?!<\|)[\x00-&(-\x7fß-öø-ÿ])+").fullmatch


def cut(raw: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of the texts in ``raw`` (UTF-8, text k ends at ``stops[k]``), and how many each has.

    A part is a run of letters in lower case, a digit or a run of other characters,
    of ASCII and Latin-1 letters, where lower case and composition are plain.  Words
    with other characters, apostrophes or ``<|``, which starts special tokens, are
    hard: one part, unchanged.
    """
    kind, lower = KINDS[raw], LOWER[raw]
    latin = np.flatnonzero(raw == 0xC3)  # leads U+00C0 to U+00FF
    after = raw[latin + 1]
    latin = latin[(after != 0x97) & (after != 0xB7)] + 1  # no × and ÷
    kind[latin] = kind[latin - 1] = LETTER
    upper = latin[raw[latin] < 0x9F]
    lower[upper] |= 0x20
    kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = HARD

    first = np.zeros(len(raw) + 1, dtype=bool)
    first[0], first[stops] = True, True
    solid = kind != SPACE
    begins = first[:-1] & solid
    begins[1:] |= solid[1:] & ~solid[:-1]
    begins = np.flatnonzero(begins)
    if len(begins):
        hard = begins[np.maximum.reduceat(kind, begins) == HARD]
        ends = first[1:] & solid
        ends[:-1] |= solid[:-1] & ~solid[1:]
        ends = np.flatnonzero(ends)
        edges = np.zeros(len(raw) + 1, dtype=np.int8)
        edges[hard] = 1
        edges[ends[np.searchsorted(ends, hard)] + 1] -= 1
        inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
        kind[inside] = HARD
        np.copyto(lower, raw, where=inside)

    starts = first[:-1] | (kind == DIGIT)
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= solid
    per_text = np.diff(np.searchsorted(np.flatnonzero(starts), stops), prepend=0)
    lower = lower[solid]
    offsets = np.append(np.flatnonzero(starts[solid]), len(lower)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(lower)]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers), per_text


class Words:
    """Encodes texts part by part with the tokenizers library.

    ``keys`` are the parts remembered, ``ids`` their token ids; as Arrow arrays they take
    some 30 bytes a part.
    """

    def __init__(self, path: str):
        # A task has one core; the library's threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), LIBRARY_TEXTS):
            some = texts[at : at + LIBRARY_TEXTS]
            for row in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                yield row.ids

    def _lines(self, parts: list[str]) -> pa.ListArray | None:
        """Encode plain parts many in one line; a token that ends a word ends a part."""
        lines = [" ".join(parts[at : at + LINE_PARTS]) for at in range(0, len(parts), LINE_PARTS)]
        ids = np.fromiter(chain.from_iterable(self._library(lines)), dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]).astype(np.int32) + 1
        if len(ends) != len(parts):
            return None
        return pa.ListArray.from_arrays(np.append(np.int32(0), ends), ids)

    def _singly(self, parts: list[str]) -> pa.ListArray:
        return pa.array(self._library(parts), pa.list_(pa.uint32()))

    def _known(self, parts: pa.Array) -> pa.ListArray:
        """The token ids of distinct ``parts``."""
        at = pc.index_in(parts, value_set=self.keys)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        if len(missing):
            texts = parts.take(pa.array(missing)).to_pylist()
            hard = np.array([PLAIN(t) is None for t in texts])
            missing = np.concatenate([missing[~hard], missing[hard]])
            plain = [t for t, h in zip(texts, hard.tolist()) if not h]
            others = [t for t, h in zip(texts, hard.tolist()) if h]
            at = at.fill_null(0).to_numpy().copy()
            at[missing] = len(self.keys) + np.arange(len(missing))
            learnt = [self._lines(plain) or self._singly(plain), self._singly(others)]
            self.keys = pa.concat_arrays([self.keys, parts.take(pa.array(missing))])
            self.ids = pa.concat_arrays([self.ids, *learnt])
        found = self.ids.take(at if isinstance(at, pa.Array) else pa.array(at))
        if len(self.keys) > CACHE_WORDS or self.keys.nbytes > CACHE_BYTES:
            self.keys, self.ids = parts, found  # the rest is forgotten
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and how many each text has.

        Texts are cut at ASCII white space; what else counts as white space is
        left to the library.
        """
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset :][: len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]]
        split, counts = cut(raw, at[1:] - at[0])
        coded = split.dictionary_encode()
        taken = self._known(coded.dictionary).take(coded.indices)
        stops = taken.offsets.to_numpy()[np.cumsum(counts)]
        return taken.flatten().to_numpy(), np.diff(stops, prepend=0)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns (ids, texts) of batches, joined up to ``CHUNK_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        more = batch.column(1).nbytes
        if held and size + more > CHUNK_BYTES:
            yield [pa.concat_arrays(c) for c in zip(*held)]
            held, size = [], 0
        held.append((batch.column(0), batch.column(1).cast(pa.string())))
        size += more
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held)]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, path: str | None = None, size: int = SIZE, ids: bool = False
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``size`` tokens, the end token included.

    ``ids`` adds the packed ids of each piece.
    """
    path = path or default_path()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    end = END.to_bytes(4, "little")

    def run(batches):
        gc.disable()  # a batch makes many short-lived lists and no cycles
        for doc_ids, texts in chunks(batches):
            ids_, sizes = words(path).encode(texts)
            rows, at = [], 0
            for doc_id, n in zip(doc_ids.to_pylist(), sizes.tolist()):
                packed = ids_[at : at + n].tobytes() + end
                at += n
                for k, first in enumerate(range(0, n + 1, size)):
                    part = packed[4 * first : 4 * (first + size)]
                    row = (doc_id, k, first, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if ids else row)
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], names
            )
        gc.enable()

    source = docs.select(F.col("doc_id").cast("long"), text_bytes("text").alias("raw"))
    return source.mapInArrow(run, fields(PIECE + ", ids binary" * ids))


class Packer:
    """Bounded-space best-fit for items of 1 to ``size``."""

    def __init__(self, size: int = SIZE, bins: int = OPEN_BINS):
        self.size, self.limit, self.open, self.number = size, bins, 0, 0
        self.filed: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]
        self.bits = 0  # bit f: some open bin has f free

    def _take(self, free: int) -> tuple[int, list]:
        bins = self.filed[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def add(self, length: int, item) -> list[tuple[int, list]]:
        """Place an item; the bins this closes, as (number, [(item, offset)])."""
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number, held = self._take(free)
        else:
            if self.open >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, number, held = self.size, self.number, []
            self.number += 1
        held.append((item, self.size - free))
        free -= length
        if free == 0:
            closed.append((number, held))
        else:
            self.filed[free].append((number, held))
            self.bits |= 1 << free
            self.open += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [self._take(free) for free, bins in enumerate(self.filed) for _ in range(len(bins))]


def _packed(round_: int, size: int, bins: int, last: bool):
    def run(batches):
        base = round_ << 56 | TaskContext.get().partitionId() << 32
        packer = Packer(size, bins)

        def rows(closed, is_open):
            flat = [(item, number, at) for number, held in closed for item, at in held]
            columns = list(zip(*[item for item, _, _ in flat])) or [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)]
                + [
                    pa.array([base | n for _, n, _ in flat], pa.int64()),
                    pa.array([at for _, _, at in flat], pa.int64()),
                    pa.array([is_open] * len(flat), pa.bool_()),
                ],
                [*schema.names, "sequence_id", "offset", "open"],
            )

        schema = None
        for batch in batches:
            schema = batch.schema
            at = schema.names.index("length")
            closed = []
            for item in zip(*[c.to_pylist() for c in batch.columns]):
                closed += packer.add(item[at], item)
            yield rows(closed, False)
        if schema is not None:
            yield rows(packer.rest(), not last)

    return run


def pack(
    items: DataFrame, size: int = SIZE, bins: int = OPEN_BINS, per_task: int = TASK_PIECES
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, rows with a ``length`` of 1 to ``size``.

    The columns should identify a row and be small; payloads are better joined later.
    """
    schema = fields("")
    for field in [*items.schema, *fields("sequence_id bigint, offset bigint, open boolean")]:
        schema.add(field)
    left, done, round_, tasks = stored(items, "pieces"), [], 0, None
    while tasks != 1:
        wanted = max(1, -(-left.count() // per_task))
        tasks = min(wanted, -(-tasks // 2)) if tasks else wanted
        spread = F.xxhash64(F.lit(round_), *items.columns)
        dealt = left.withColumn("_spread", spread).repartition(tasks, "_spread")
        dealt = dealt.sortWithinPartitions("_spread", *items.columns).drop("_spread")
        out = stored(dealt.mapInArrow(_packed(round_, size, bins, tasks == 1), schema), "packed")
        done.append(out.where("not open").drop("open"))
        left, round_ = out.where("open").select(*items.columns), round_ + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of whole sequences, from pieces with ``ids``."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(in_order, F.lit(b""), lambda all_, one: F.concat(all_, one["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
