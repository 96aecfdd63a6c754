"""Alignment of two tokenizers over the same text (operator 11).

``A`` is a byte-level tokenizer, ``B`` a piece tokenizer with byte fallback; both
read the text with one space in front.  Their spans give coarse cuts: places
where a token of ``A`` ends by its character offsets and a piece of ``B`` by its
span in the encoded text, and where neither goes on inside a character.  Tokens
that share a character (bytes of a multibyte character, byte-fallback pieces)
hide cuts from the spans, so each coarse stretch with several tokens on both
sides is refined by the lengths of the decoded bytes.  The stretches between cuts
are groups; every token of ``A`` in a group is linked to every one of ``B``.

No token of either side spans a place where a space follows another character,
so a text is a sequence of units (spaces, then no spaces; spaces at the end belong
to the last), and a unit met before is not encoded again.  For the same reason short
units are encoded many in one line and aligned together.  A text with a unit that does not decode to itself is
encoded as a whole.

How many documents hold an id pair linked is counted over the corpus:

1. a task handles blocks of documents of about ``BLOCK_BYTES``; a block becomes
   one stored row with its units, its distinct pairs and the documents per pair;
2. pairs are summed over blocks, and the highest count per id of ``A`` is found
   (one row per vocabulary entry);
3. each block asks for its distinct pairs, a join on the pair, and gets one list
   back, bounded like the block; sums per document follow from it.

So what crosses the network is distinct pairs per block, not links.

Null and empty texts, and texts whose joined token bytes on either side differ
from the text, have no tokens: zeros and an empty digest.  Repeated rows are
documents of their own.  Null ids are kept.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.bpe import byte_alphabet
from bandstream.llm.common import Generations, fields, fresh, stored, table, text_bytes

BLOCK_BYTES = 4 << 20
#: Units remembered per generation.
CACHE_UNITS = 150_000
#: Units handed to the tokenizers at once.
ENCODE_UNITS = 2000
#: Characters of a unit that is encoded in one line with others, at most.
JOINED_CHARS = 100
#: Units below which a line that does not decode to itself is not cut further.
FEW_UNITS = 50
#: Links of a group above which repeated ids are counted before they are paired.
MANY_LINKS = 64

NOTHING = ("", bytes(40))
UNITS = re.compile(r" +[^ ]+(?: +\Z)?| +\Z").findall


#: An aligned unit: its groups as text; 64-bit integers: the numbers of A tokens, B tokens,
#: groups, links and distinct id pairs, the packed pairs, and how often each is linked
#: (left out if once).
Unit = tuple[str, bytes]


class Aligner:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = {
            i: bytes(byte_of[c] for c in token) if set(token) <= byte_of.keys() else token.encode()
            for token, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        self.size_a = max(self.a_bytes) + 1
        self.size_b = self.b.get_piece_size()
        self.is_byte = [self.b.is_byte(i) for i in range(self.size_b)]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.is_byte[i] else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.size_b)))
        ]
        self.a_width = np.zeros(self.size_a, dtype=np.int64)
        self.a_width[list(self.a_bytes)] = [len(b) for b in self.a_bytes.values()]
        self.b_width = np.array([len(b) for b in self.b_bytes])
        self.shows = [str(i) for i in range(max(self.size_a, self.size_b))]
        self.shown = pa.array(self.shows)
        self.known = Generations(CACHE_UNITS)

    def spans(self, texts: list[str]):
        """Per text with its leading space: ids and spans of A (characters) and B (bytes)."""
        left = self.a.encode_batch(texts, add_special_tokens=False)
        right = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        for text, a, b in zip(texts, left, right):
            pieces = b.pieces
            yield text, a.ids, a.offsets, [p.id for p in pieces], [(p.begin, p.end) for p in pieces]

    def _coarse(self, text, a_spans, b_ids, b_spans) -> list[tuple[int, int]]:
        """Token counts of A and B up to each place where the spans of both end."""
        if text.isascii():  # a character is a byte: every end counts, and none hides a cut
            ends = {end: i for i, (_, end) in enumerate(a_spans, 1)}
            return [(ends[end + 1], j) for j, (_, end) in enumerate(b_spans, 1) if end + 1 in ends]
        at, total = [0], 0
        for c in text:
            total += len(c.encode())
            at.append(total)
        ends, last = {}, len(a_spans) - 1
        for i, (_, end) in enumerate(a_spans):
            if i == last or a_spans[i + 1][0] >= end:
                ends[at[end]] = i + 1
        cuts, done, last = [], 0, len(b_spans) - 1
        for j, (begin, end) in enumerate(b_spans):
            if j < last and (b_spans[j + 1][0] < end or (begin == end and self.is_byte[b_ids[j]])):
                continue
            found = ends.get(end + 1, 0)  # one more for the leading space
            if found > done:
                cuts.append((found, j + 1))
                done = found
        return cuts

    def cuts(self, text, a_ids, a_spans, b_ids, b_spans) -> list[tuple[int, int]] | None:
        """Token counts (A, B) at each common end; None if the bytes do not join to the text."""
        raw = text.encode()
        if b"".join([self.a_bytes[a] for a in a_ids]) != raw:
            return None
        if b"".join([self.b_bytes[b] for b in b_ids]) != raw:
            return None
        coarse = self._coarse(text, a_spans, b_ids, b_spans)
        whole = (len(a_ids), len(b_ids))
        if not coarse or coarse[-1] != whole:
            coarse.append(whole)
        if text.isascii():
            return coarse
        out, a_from, b_from = [], 0, 0
        for a_to, b_to in coarse:
            if a_to - a_from > 1 and b_to - b_from > 1:
                self._refine(a_ids, b_ids, a_from, a_to, b_from, b_to, out)
            out.append((a_to, b_to))
            a_from, b_from = a_to, b_to
        return out

    def _refine(self, a_ids, b_ids, i, a_to, j, b_to, out) -> None:
        """Common ends inside a coarse stretch, by the lengths of decoded bytes."""
        left, right = len(self.a_bytes[a_ids[i]]), len(self.b_bytes[b_ids[j]])
        i, j = i + 1, j + 1
        while i < a_to and j < b_to:
            if left == right:
                out.append((i, j))
            if left <= right:
                left += len(self.a_bytes[a_ids[i]])
                i += 1
            else:
                right += len(self.b_bytes[b_ids[j]])
                j += 1
        # behind the last token of one side there is no end but the stretch's own

    def unit(self, text, a_ids, a_spans, b_ids, b_spans) -> Unit | None:
        cuts = self.cuts(text, a_ids, a_spans, b_ids, b_spans)
        if cuts is None:
            return None
        links: dict[int, int] = {}
        shown, i, j, n_links, shows, size_b = [], 0, 0, 0, self.shows, self.size_b
        for a_to, b_to in cuts:
            if a_to - i == 1 == b_to - j:
                a, b = a_ids[i], b_ids[j]
                shown.append(f"{shows[a]}|{shows[b]}")
                n_links += 1
                links[a * size_b + b] = links.get(a * size_b + b, 0) + 1
            else:
                left, right = a_ids[i:a_to], b_ids[j:b_to]
                shown.append(
                    f"{','.join([shows[a] for a in left])}|{','.join([shows[b] for b in right])}"
                )
                n_links += len(left) * len(right)
                if len(left) * len(right) > MANY_LINKS:
                    left, right = Counter(left), Counter(right)
                    for a, n in left.items():
                        for b, m in right.items():
                            links[a * size_b + b] = links.get(a * size_b + b, 0) + n * m
                else:
                    for a in left:
                        for b in right:
                            links[a * size_b + b] = links.get(a * size_b + b, 0) + 1
            i, j = a_to, b_to
        numbers = array("q", [len(a_ids), len(b_ids), len(cuts), n_links, len(links), *links])
        if len(links) != n_links:
            numbers.extend(links.values())
        return ";".join(shown), numbers.tobytes()

    def units(self, texts: list[str]) -> list[Unit | None]:
        """The aligned units of distinct ``texts``, each with its leading space."""
        known = self.known.get(texts, self._learn)
        return [known[t] for t in texts]

    def _learn(self, texts: list[str]) -> dict[str, Unit | None]:
        found, ascii, short, others = {}, [], [], []
        for text in texts:
            kind = others if not one_line(text) else ascii if text.isascii() else short
            kind.append(text)
        lines = [
            kind[at : at + ENCODE_UNITS]
            for kind in (ascii, short)
            for at in range(0, len(kind), ENCODE_UNITS)
        ]
        while lines:
            line = lines.pop()
            made = self.line(line)
            if made is not None:
                found.update(zip(line, made))
            elif len(line) > FEW_UNITS:  # some unit does not decode to itself
                part = -(-len(line) // 8)
                lines += [line[at : at + part] for at in range(0, len(line), part)]
            else:
                others += line
        for at in range(0, len(others), ENCODE_UNITS):
            for row in self.spans(others[at : at + ENCODE_UNITS]):
                found[row[0]] = self.unit(*row)
        return found

    def line(self, units: list[str]) -> list[Unit] | None:
        """What :meth:`unit` gives, for short units encoded as one text.

        None if the bytes do not join to the text or a unit does not end with tokens
        of both sides.
        """
        text = "".join(units)
        raw, left = text.encode(), self.a.encode(text, add_special_tokens=False)
        right = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        a_ids, b_ids = left.ids, [p.id for p in right]
        if b"".join([self.a_bytes[a] for a in a_ids]) != raw:
            return None
        if b"".join([self.b_bytes[b] for b in b_ids]) != raw:
            return None
        a_ids, b_ids = np.array(a_ids), np.array(b_ids)
        a_ends, b_ends = np.cumsum(self.a_width[a_ids]), np.cumsum(self.b_width[b_ids])
        unit_ends = np.cumsum([len(t) for t in units])

        # coarse cuts: spans of both sides end, and neither goes on inside a character
        if text.isascii():  # a character is a byte: every end counts, and none hides a cut
            a_cuts = np.array([end for _, end in left.offsets])
            b_cuts = np.array([p.end for p in right]) + 1  # one more for the leading space
        else:
            chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            widths = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(widths)])
            unit_ends = byte_at[unit_ends]
            spans = np.array(left.offsets)
            whole = np.append(spans[1:, 0] >= spans[:-1, 1], True)
            a_cuts = byte_at[spans[whole, 1]]
            begin, end = np.array([p.begin for p in right]), np.array([p.end for p in right])
            hidden = np.array(self.is_byte)[b_ids] & (begin == end)
            whole = np.append((begin[1:] >= end[:-1]) & ~hidden[:-1], True)
            b_cuts = end[whole] + 1
        sides = (a_ends, b_ends)
        if any((np.diff(side) <= 0).any() for side in (*sides, a_cuts, b_cuts)):
            return None
        ends = np.intersect1d(a_cuts, b_cuts, assume_unique=True)
        # inside a stretch with several tokens on both sides: the decoded bytes
        if not len(ends) or ends[-1] != len(raw):
            return None
        sizes = [np.diff(np.searchsorted(side, ends, "right"), prepend=0) for side in sides]
        several = (sizes[0] > 1) & (sizes[1] > 1)
        if several.any():
            inside = [side[np.repeat(several, n)] for side, n in zip(sides, sizes)]
            ends = np.union1d(ends, np.intersect1d(*inside, assume_unique=True))
        for some, side in ((ends, a_ends), (ends, b_ends), (unit_ends, ends)):
            found = np.searchsorted(side, some)
            if found[-1] == len(side) or (side[found] != some).any():
                return None
        # token counts up to each group's end, and group counts up to each unit's end
        a_at, b_at, at = (
            np.concatenate([[0], np.searchsorted(whole, some, "right")])
            for whole, some in ((a_ends, ends), (b_ends, ends), (ends, unit_ends))
        )
        joined = [
            pc.binary_join(
                pa.ListArray.from_arrays(groups.astype(np.int32), self.shown.take(pa.array(ids))), ","
            )
            for groups, ids in ((a_at, a_ids), (b_at, b_ids))
        ]
        groups = pc.binary_join_element_wise(*joined, "|")
        shown = pc.binary_join(pa.ListArray.from_arrays(at.astype(np.int32), groups), ";")

        n_a, n_b = np.diff(a_at), np.diff(b_at)
        linked = n_a * n_b
        group = np.repeat(np.arange(len(ends)), linked)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(linked) - linked, linked)
        codes = a_ids[a_at[group] + nth // n_b[group]] * self.size_b
        codes += b_ids[b_at[group] + nth % n_b[group]]
        unit = np.repeat(np.arange(len(units)), np.diff(at))[group]
        wide = self.size_a * self.size_b
        pairs, times = np.unique(unit * wide + codes, return_counts=True)
        n_pairs = np.bincount(pairs // wide, minlength=len(units))
        n_links = np.bincount(unit, minlength=len(units))
        again = n_pairs != n_links
        sizes = 5 + n_pairs * (1 + again)
        stops = np.cumsum(sizes)
        begin = stops - sizes
        numbers = np.empty(stops[-1], dtype="<i8")
        counted = (np.diff(a_at[at]), np.diff(b_at[at]), np.diff(at), n_links, n_pairs)
        for k, values in enumerate(counted):
            numbers[begin + k] = values
        numbers[_expand(begin + 5, n_pairs)] = pairs % wide
        numbers[_expand((begin + 5 + n_pairs)[again], n_pairs[again])] = times[
            np.repeat(again, n_pairs)
        ]
        data = numbers.tobytes()
        cut = [data[8 * b : 8 * e] for b, e in zip(begin.tolist(), stops.tolist())]
        return list(zip(shown.to_pylist(), cut))


def one_line(unit: str) -> bool:
    """A short unit behind one space, without other spaces or control characters but line ends."""
    return (
        1 < len(unit) <= JOINED_CHARS
        and unit.rfind(" ") == 0
        and (unit.isprintable() or unit.replace("\n", "").isprintable())
    )


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def aligned(
    df: DataFrame, text: str = "text", groups: str = "groups",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``groups``: per group its ids on both sides and the end of its bytes.

    The end counts the bytes of the text with one space in front.  A column of
    that name is replaced.
    """
    paths = paths or default_paths()
    kind = pa.list_(
        pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())])
    )

    def one(tool: Aligner, text: str):
        out, i, j, end = [], 0, 0, 0
        for row in tool.spans([" " + text]) if text else ():
            for a_to, b_to in tool.cuts(*row) or ():
                left, right = row[1][i:a_to], row[3][j:b_to]
                end += sum(len(tool.a_bytes[a]) for a in left)
                out.append({"a": left, "b": right, "end": end})
                i, j = a_to, b_to
        return out

    def run(batches):
        for batch in batches:
            tool = aligner(*paths)
            found = [one(tool, t.decode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], groups]
            )

    df = df.select(*[c for c in df.columns if c == text or c.lower() != groups.lower()])
    (raw,) = fresh(df, "raw")
    rows = df.select(*df.columns, text_bytes(text).alias(raw))
    schema = fields("")
    added = fields(f"`{groups}` array<struct<a:array<int>,b:array<int>,end:bigint>>")
    for field in [*df.schema, *added]:
        schema.add(field)
    return rows.mapInArrow(run, schema)


def _pack(values, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + sizes[i]``."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return np.arange(ends[-1] if len(ends) else 0) + shift


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


BLOCK = """
    block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>,
    n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>,
    doc_units binary, unit_at binary, unit_times binary,
    unit_pairs binary, pair_at binary, pair_times binary,
    pairs array<bigint>, held array<bigint>
"""


def _split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the unit at each place of the texts, and the places per text."""
    odd = [not t or "  " in t or t[0] == " " or t[-1] == " " for t in texts]
    plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.string())
    split = pc.split_pattern(plain, " ")
    places = iter(pc.list_value_length(split).to_pylist())
    # a unit without its first space stands for it
    rest = [[u[1:] for u in UNITS(" " + t)] if t else [] for t, o in zip(texts, odd) if o]
    more = pa.array([u for units in rest for u in units], pa.string())
    coded = pa.chunked_array([split.flatten(), more]).combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    others = iter(map(len, rest))
    sizes = np.array([next(others) if o else next(places) for o in odd], dtype=np.int64)
    # plain texts first, odd ones behind them: back to the order of the texts
    odd = np.array(odd, dtype=bool)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    first = np.empty(len(texts), dtype=np.int64)
    first[order] = np.cumsum(sizes[order]) - sizes[order]
    return [" " + u for u in coded.dictionary.to_pylist()], at[_expand(first, sizes)], sizes


def _block(tool: Aligner, number: int, ids: list, texts: list[str]) -> dict:
    """One row for a block of documents."""
    names, flat, sizes = _split(texts)
    flat, ends = flat.astype(np.int64), np.cumsum(sizes)
    units = tool.units(names)
    broken = np.array([u is None for u in units], dtype=bool)
    if broken.any():
        split = [flat[e - s : e] for e, s in zip(ends, sizes)]
        for k, found in enumerate(split):
            if broken[found].any():
                (whole,) = tool.units([" " + texts[k]])
                split[k] = np.array([] if whole is None else [len(units)], dtype=np.int64)
                if whole is not None:
                    units.append(whole)
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        flat, ends = np.concatenate(split), np.cumsum(sizes)
    units = [u or NOTHING for u in units]
    shown = [u[0] for u in units]
    lengths = np.array([len(u[1]) >> 3 for u in units], dtype=np.int64)
    numbers = np.frombuffer(b"".join([u[1] for u in units]), dtype="<i8")
    begin = np.cumsum(lengths) - lengths
    sums = numbers[begin[:, None] + np.arange(4)]
    pair_sizes = numbers[begin + 4]
    starts = np.cumsum(pair_sizes) - pair_sizes
    codes = numbers[_expand(begin + 5, pair_sizes)]
    times = np.ones(len(codes), dtype=np.int64)
    again = lengths > 5 + pair_sizes
    times[_expand(starts[again], pair_sizes[again])] = numbers[
        _expand((begin + 5 + pair_sizes)[again], pair_sizes[again])
    ]
    pairs, pair_at = np.unique(codes, return_inverse=True)

    docs = np.repeat(np.arange(len(texts)), sizes)
    width = max(len(units), 1)
    entries, entry_times = np.unique(docs * width + flat, return_counts=True)
    entry_doc, entry_unit = entries // width, entries % width

    held_at = _expand(starts[entry_unit], pair_sizes[entry_unit])
    wide = max(len(pairs), 1)
    held = np.unique(np.repeat(entry_doc, pair_sizes[entry_unit]) * wide + pair_at[held_at])
    out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), np.zeros((4, len(texts)), np.int64)))
    for k, name in enumerate(out):
        out[name] = _sums(sums[flat, k], sizes).tolist()
    digest = lambda s: hashlib.sha256(";".join([shown[u] for u in s]).encode()).hexdigest()
    return out | {
        "block": number,
        "doc_id": ids,
        "groups_sha256": [
            digest(flat[e - n : e].tolist()) if n else "" for e, n in zip(ends, sizes)
        ],
        "doc_units": _pack(np.bincount(entry_doc, minlength=len(texts)), "<i4"),
        "unit_at": _pack(np.diff(entry_unit, prepend=0), "<i4"),
        "unit_times": _pack(entry_times, "<i4"),
        "unit_pairs": _pack(pair_sizes, "<i4"),
        "pair_at": _pack(pair_at, "<i4"),
        "pair_times": _pack(times, "<i4"),
        "pairs": pairs.tolist(),
        "held": np.bincount(held % wide, minlength=len(pairs))[: len(pairs)].tolist(),
    }


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row per block of ``docs`` (doc_id, text), see ``BLOCK``."""
    schema = pa.schema(
        [(f.name, _arrow(f.dataType.simpleString())) for f in fields(BLOCK)]
    )

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            found = _block(aligner(*paths), part << 32 | number, ids, texts)
            return pa.RecordBatch.from_pylist([found], schema)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(raw.decode())
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes("text").alias("raw"))
    return rows.mapInArrow(run, fields(BLOCK))


def _arrow(kind: str) -> pa.DataType:
    return {
        "bigint": pa.int64(),
        "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()),
    }[kind]


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, value): twice the documents that hold the pair, plus 1 if no pair of
    the same A id is held by more."""
    summed = (
        rows.select(F.inline(F.arrays_zip("pairs", "held")))
        .groupBy(F.col("pairs").alias("pair"))
        .agg(F.sum("held").alias("n"))
    )
    summed = stored(summed.withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    # one row per vocabulary entry of A: bounded, whatever the corpus
    most = summed.groupBy("a").agg(F.max("n").alias("most"))
    best = (F.col("n") == F.col("most")).cast("long")
    return summed.join(F.broadcast(most), "a").select("pair", (F.col("n") * 2 + best).alias("value"))


COUNTED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = "".join(f"{name} bigint, " for name in COUNTED) + "groups_sha256 string"


def _scores(batches):
    schema = pa.schema([(n, pa.int64()) for n in COUNTED] + [("groups_sha256", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: batch.column(batch.schema.names.index(name))[row]
            answers = get("answers").values
            value = np.zeros(len(get("pairs").values), np.int64)
            if answers is not None:
                value[np.asarray(answers.field("pos"))] = np.asarray(answers.field("value"))
            pair_at = _unpack(get("pair_at").as_py(), "<i4")
            times = _unpack(get("pair_times").as_py(), "<i4").astype(np.int64)
            sizes = _unpack(get("unit_pairs").as_py(), "<i4").astype(np.int64)
            counts = _sums((value >> 1)[pair_at] * times, sizes)
            best = _sums((value & 1)[pair_at] * times, sizes)
            unit = np.cumsum(_unpack(get("unit_at").as_py(), "<i4"))
            often = _unpack(get("unit_times").as_py(), "<i4").astype(np.int64)
            of_doc = _unpack(get("doc_units").as_py(), "<i4").astype(np.int64)
            whole = {n: get(n).values for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            whole["n_best"] = pa.array(_sums(best[unit] * often, of_doc))
            whole["count_sum"] = pa.array(_sums(counts[unit] * often, of_doc))
            whole["groups_sha256"] = get("groups_sha256").values
            yield pa.RecordBatch.from_arrays([whole[n] for n in schema.names], schema=schema)


def digests(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document: sizes of its alignment, its links by corpus-wide counts, a digest."""
    paths = paths or default_paths()
    rows = stored(blocks(docs, paths), "blocks")
    counts = stored(pair_counts(rows, aligner(*paths).size_b), "pair-values")
    asked = rows.select("block", F.posexplode("pairs").alias("pos", "pair"))
    answers = (
        asked.join(counts, "pair")
        .groupBy("block")
        .agg(F.collect_list(F.struct("pos", "value")).alias("answers"))
    )
    return rows.drop("held").join(answers, "block", "left").mapInArrow(_scores, fields(RESULT))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
