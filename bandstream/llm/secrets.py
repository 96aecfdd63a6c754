"""Secret scan: three fixed patterns and a character network (operator 10).

The patterns give the base findings.  The network reads every other candidate
(an unbroken run of at least six token characters that is not a plain word) in
overlapping windows together with the characters around it, and adds those where
it takes one of the windows for a secret.

* Architecture: character classes one-hot embedded and learned, one convolution,
  global max pooling, one logistic output; all in numpy.
* Labels: windows that hold a part of a base finding's value are positive, those
  outside of findings negative.  The key word in front of an assignment is hidden from the network
  in half of the training rows, so that it learns the value and not the word.
* The fit reads every window of every document.  Windows are dealt by hash into
  shards of about ``SHARD_ROWS``; each shard trains from the same parameters, which
  are then averaged by rows, ``ROUNDS`` times.
* Calibration on a held-out third of all candidates: Platt scaling, and the highest
  threshold on a grid of 1 / ``GRID`` logits that keeps ``RECALL`` of the held-out
  secrets, whatever ``precision`` results.  Both read counts per grid cell.

Null texts are empty texts and have no findings.  Texts of any length are
scanned whole.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import discard, fields, stored, table

KINDS = ("assign", "access", "hex")
ADDED = "model"
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

#: A candidate: a run of token characters, long enough, that prose does not have:
#: anything but a plain word, letters of one case up to the length of long words.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PROSE = re.compile(r"[^A-Za-z0-9]*(?:[A-Z]?[a-z]{1,20}|[A-Z]{1,20})[^A-Za-z0-9]*")

RECALL = 0.95
#: Windows of a shard, on average, and how often shards train and are averaged.
SHARD_ROWS, ROUNDS, EPOCHS = 50_000, 3, 2
#: Cells per unit of the logit, and the largest logit told apart.
GRID, LIMIT = 256, 50
SPAN, BEFORE, AFTER = 48, 16, 8
#: Windows of a long candidate start so many characters apart.
STEP = 24
WIDTH = BEFORE + SPAN + AFTER
FILTERS, KERNEL, EMBED = 24, 5, 8
CLASSES = 64


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base findings in order.

    The two run patterns ask for their least length at once: a maximal run that
    is too short cannot contain a long enough match.  The assignment pattern
    cannot do that, because a match that is too short still uses up its text.
    """
    found = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates."""
    return [m.span() for m in CANDIDATE.finditer(text) if not PROSE.fullmatch(m[0])]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping stretches of at most ``SPAN`` characters that cover a candidate."""
    last = max(start, end - SPAN)
    return [(at, min(end, at + SPAN)) for at in (*range(start, last, STEP), last)]


def values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the secrets themselves: an assignment without its key word."""
    return [
        (ASSIGN.match(text, start).start(2) if kind == 0 else start, end)
        for start, kind, end in base
    ]


def character_classes() -> np.ndarray:
    """Class of each code point below 128: hex letters, digits, signs apart."""
    classes = np.full(129, 1, dtype=np.int64)
    for i, c in enumerate("0123456789abcdefABCDEF"):
        classes[ord(c)] = 2 + i
    for c in range(128):
        shown = chr(c)
        if classes[c] > 1:
            continue
        if shown.isspace():
            classes[c] = 24
        elif shown.isalpha():
            classes[c] = 25 + (shown.lower() in "aeiou") + 2 * shown.isupper()
        elif 32 < c < 127:
            classes[c] = 29 + (c % 34)
    return classes


CLASS_OF = character_classes()
LEARNED = ("embed", "filters", "bias", "weights")
NAMES = ["row", "start", "salt", "label", "seen"]


def window(text: str, start: int, end: int, hide: bool = False) -> np.ndarray:
    """Classes of a stretch's first ``SPAN`` characters and the text around it; 0 pads."""
    out = np.zeros(WIDTH, dtype=np.int64)
    before = "" if hide else text[max(0, start - BEFORE) : start]
    body = text[start : min(end, start + SPAN)]
    after = text[end : end + AFTER]
    for at, part in ((BEFORE - len(before), before), (BEFORE, body), (BEFORE + SPAN, after)):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[at : at + len(codes)] = CLASS_OF[np.minimum(codes, 128)]
    return out


@dataclass
class Network:
    """Embedding, convolution, max pooling, logistic output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    precision: float = 1.0

    @classmethod
    def start(cls, seed: int = 7) -> "Network":
        draw = np.random.default_rng(seed)
        return cls(
            draw.normal(0, 0.5, (CLASSES, EMBED)),
            draw.normal(0, 0.3, (KERNEL * EMBED, FILTERS)),
            np.zeros(FILTERS),
            draw.normal(0, 0.3, FILTERS),
            0.0,
        )

    def _forward(self, x: np.ndarray):
        vectors = self.embed[x]
        patches = np.lib.stride_tricks.sliding_window_view(vectors, KERNEL, axis=1)
        patches = patches.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, -1)
        maps = patches @ self.filters + self.bias
        best = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, best[:, None, :], 1)[:, 0], 0)
        return patches, best, pooled, pooled @ self.weights + self.offset

    def logits(self, x: np.ndarray) -> np.ndarray:
        pieces = [self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]
        return np.concatenate(pieces) if pieces else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def parameters(self) -> np.ndarray:
        return np.concatenate([*[getattr(self, n).reshape(-1) for n in LEARNED], [self.offset]])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in LEARNED:
            part = getattr(self, name)
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        self.offset = float(flat[at])

    def fit(
        self,
        x: np.ndarray,
        y: np.ndarray,
        epochs: int = 6,
        rate: float = 0.01,
        share: float | None = None,
    ) -> None:
        """Adam on the logistic loss; both classes weigh alike at a ``share`` of positives."""
        draw = np.random.default_rng(11)
        share = y.mean() if share is None else share
        weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        names = LEARNED
        moments = {n: [np.zeros_like(getattr(self, n)) for _ in range(2)] for n in names}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for rows in np.array_split(order, max(1, len(order) // 64)):
                patches, best, pooled, logit = self._forward(x[rows])
                error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[rows]) * weight[rows]
                error /= len(rows)
                through = error[:, None] * self.weights * (pooled > 0)
                chosen = np.take_along_axis(patches, best[:, :, None], 1)
                grad = {
                    "weights": pooled.T @ error,
                    "bias": through.sum(0),
                    "filters": np.einsum("rfk,rf->kf", chosen, through),
                    "embed": np.zeros_like(self.embed),
                }
                back = through[:, :, None] * self.filters.T[None]
                places = best[:, :, None] + np.arange(KERNEL)
                classes = x[rows][np.arange(len(rows))[:, None, None], places]
                np.add.at(
                    grad["embed"],
                    classes.reshape(-1),
                    back.reshape(len(rows), FILTERS, KERNEL, EMBED).reshape(-1, EMBED),
                )
                step += 1
                self.offset -= rate * error.sum()
                for name in names:
                    mean, square = moments[name]
                    mean += 0.1 * (grad[name] - mean)
                    square += 0.001 * (grad[name] ** 2 - square)
                    change = (mean / (1 - 0.9**step)) / (
                        np.sqrt(square / (1 - 0.999**step)) + 1e-8
                    )
                    getattr(self, name)[...] -= rate * change

    def calibrate(self, x: np.ndarray, y: np.ndarray, owners: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the recall-constrained threshold.

        The threshold is set for whole candidates: the best of their windows counts.
        """
        z = self.logits(x)
        self.platt(z, y, np.ones(len(y)))
        z = np.clip(self.scale * z + self.shift, -LIMIT, LIMIT)
        if owners is not None:
            whose = np.unique(owners, return_inverse=True)[1]
            best, is_secret = np.full(whose.max() + 1, -np.inf), np.zeros(whose.max() + 1)
            np.maximum.at(best, whose, z)
            np.maximum.at(is_secret, whose, y)
            z, y = best, is_secret
        self.cut(z, y, np.ones(len(y)))

    def platt(self, z: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        """Platt scaling by Newton steps; ``count`` rows have the logit and the label."""
        a, b = 1.0, 0.0
        positive = (y * count).sum()
        target = np.where(
            y > 0, (positive + 1) / (positive + 2), 1 / (((1 - y) * count).sum() + 2)
        )
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            slope = (p * (1 - p) + 1e-9) * count
            off = (p - target) * count
            g = np.array([(off * z).sum() + 1e-3 * a, off.sum()])
            h = np.array(
                [[(slope * z * z).sum() + 1e-3, (slope * z).sum()], [(slope * z).sum(), slope.sum()]]
            )
            move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        self.scale, self.shift = float(a), float(b)

    def cut(self, z: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        """The highest grid value that ``RECALL`` of the secrets reach, by scaled logits."""
        order = np.argsort(z)
        z, secret, count = z[order], (y * count)[order], count[order]
        if not secret.sum():
            return
        allowed = np.floor((1 - RECALL) * secret.sum())
        least = np.floor(z[np.searchsorted(np.cumsum(secret), allowed, side="right")] * GRID) / GRID
        self.threshold = float(1 / (1 + np.exp(-least)))
        kept = z >= least
        self.precision = float(secret[kept].sum() / count[kept].sum())


def examples(text: str, salt: int):
    """(start of its candidate, window, label) of all labelled windows of a text.

    A window is positive if it holds a part of a secret's value.  Stretches that
    only touch the key word of a finding are neither positive nor negative.
    """
    base = base_findings(text)
    secret = values(text, base)
    for start, end in candidates(text):
        near = [(s, e) for s, e in secret if s < end and start < e]
        touched = any(s < end and start < e for s, _, e in base)
        for a, b in pieces(start, end):
            label = any(s < b and a < e for s, e in near)
            if label or not touched:
                hide = bool(label and (salt + start) % 2)
                yield start, window(text, a, b, hide).astype(np.uint8), label


def labelled(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and labels of all candidates of the texts, and whose window each is."""
    windows, labels, owners, known = [], [], [], {}
    for n, text in enumerate(texts):
        for start, seen, label in examples(text, n):
            windows.append(seen)
            labels.append(float(label))
            owners.append(known.setdefault((n, start), len(known)))
    return np.array(windows).reshape(-1, WIDTH), np.array(labels), np.array(owners, dtype=np.int64)


def training_rows(texts) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of all candidates of the texts."""
    return labelled(texts)[:2]


def train(texts: list[str]) -> Network:
    """Fit on two thirds of the labelled findings of a few texts, calibrate on the rest.

    Without findings of both classes nothing can be learned: the network then
    adds no span.
    """
    x, y, owners = labelled(texts)
    net = Network.start()
    count = int(owners.max(initial=-1)) + 1
    held = (np.random.default_rng(3).permutation(count) % 3 == 2)[owners]
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        net.threshold = 2.0
        return net
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held], owners[held])
    return net


def training_windows(docs: DataFrame) -> DataFrame:
    """Every labelled window of all documents: (row, start, h, held, label, seen).

    ``row`` and ``start`` say whose window it is.  ``h``, a hash of the text and the
    place, deals and orders the windows, so that copies are held out together.
    """

    def run(batches):
        for batch in batches:
            found = []
            for row, salt, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for start, seen, label in examples(text, salt):
                    found.append((row, start, salt, label, seen.tobytes()))
                    if len(found) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], NAMES)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], NAMES)

    texts = docs.where(F.length("text") > 0).select(
        F.monotonically_increasing_id(), F.xxhash64("text"), "text"
    )
    found = texts.mapInArrow(run, "row long, start long, salt long, label boolean, seen binary")
    return found.select(
        "row",
        "start",
        F.xxhash64("salt", "start", "seen").alias("h"),
        (F.pmod(F.xxhash64("start", "salt"), F.lit(3)) == 2).alias("held"),
        "label",
        "seen",
    )


def classes_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)


def learn(docs: DataFrame) -> Network:
    """The network, fitted and calibrated on all documents (see :func:`train`)."""
    net = Network.start()
    windows = stored(training_windows(docs), "windows")
    sizes = {
        (r["held"], r["label"]): r["count"]
        for r in windows.groupBy("held", "label").count().collect()
    }
    if len(sizes) == 4:
        fit_shards(net, windows.where("NOT held"), sizes[False, True], sizes[False, False])
        calibrate_all(net, windows.where("held"))
    discard(windows)
    return net


def fit_shards(net: Network, windows: DataFrame, positive: int, negative: int) -> None:
    rows = positive + negative
    shards = -(-rows // SHARD_ROWS)
    # copies are numbered, so that they are dealt over all shards whatever their rows
    copies = windows.groupBy("h", "label", "seen").agg(F.count("*").alias("n"))
    copies = copies.select(
        "h", "label", "seen", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")
    )
    shard = F.pmod(F.xxhash64("h", "copy"), F.lit(shards)).alias("shard")
    dealt = copies.select(shard, "h", "label", "seen")
    for _ in range(ROUNDS):
        begin = net.parameters()

        def solve(group: pa.Table) -> pa.Table:
            group = group.sort_by("h")
            own = Network.start()
            own.load(begin)
            labels = group["label"].to_numpy().astype(float)
            own.fit(classes_of(group["seen"]), labels, EPOCHS, share=positive / rows)
            flat = own.parameters()
            at = np.arange(len(flat), dtype=np.int32)
            return pa.table({"at": at, "value": flat * (len(labels) / rows)})

        solved = dealt.groupBy("shard").applyInArrow(solve, "at int, value double")
        means = solved.groupBy("at").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(len(begin))
        flat[[r["at"] for r in means]] = [r["value"] for r in means]
        # sums come in any order: only digits that do not depend on it are kept
        net.load(np.round(flat, 9))


def calibrate_all(net: Network, windows: DataFrame) -> None:
    def judge(batches):
        for batch in batches:
            z = net.logits(classes_of(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z)], [*NAMES[:2], "label", "z"])

    def cells(rows: DataFrame) -> list[np.ndarray]:
        """Centre, label and rows of each grid cell."""
        cell = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "z")) * GRID)
        counted = rows.groupBy(cell.alias("cell"), "label").count().collect()
        cell, label, count = np.array([tuple(r) for r in counted], dtype=float).T
        return [(cell + 0.5) / GRID, label, count]

    judged = windows.select("row", "start", "label", "seen").mapInArrow(
        judge, "row long, start long, label boolean, z double"
    )
    judged = stored(judged, "logits")
    net.platt(*cells(judged))
    scaled = judged.withColumn("z", F.col("z") * F.lit(net.scale) + F.lit(net.shift))
    net.cut(*cells(scaled.groupBy("row", "start").agg(F.max("z").alias("z"), F.max("label").alias("label"))))
    discard(judged)


def joined(spans, names) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, counts of base findings, the base spans and all spans as strings."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = (*KINDS, ADDED)

    def run(batches):
        net = shared.value
        for batch in batches:
            found = [base_findings(t) for t in batch["text"]]
            spans = [list(f) for f in found]
            places, windows, owners = [], [], []

            def judge():
                best = np.zeros(len(places))
                np.maximum.at(best, owners, net.probability(np.array(windows)))
                for (n, start, end), p in zip(places, best):
                    if p >= net.threshold:
                        spans[n].append((start, len(KINDS), end))
                for kept in (places, windows, owners):
                    kept.clear()

            for n, text in enumerate(batch["text"]):
                for start, end in candidates(text):
                    if not any(b < end and start < e for b, _, e in found[n]):
                        for a, b in pieces(start, end):
                            windows.append(window(text, a, b))
                            owners.append(len(places))
                        places.append((n, start, end))
                        if len(windows) >= 10_000:
                            judge()
            if places:
                judge()
            counts = {
                f"n_{kind}": [sum(s[1] == k for s in f) for f in found]
                for k, kind in enumerate(KINDS)
            }
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    **counts,
                    "base": [joined(f, names) for f in found],
                    "spans": [joined(s, names) for s in spans],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(
        run,
        fields(
            f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string"
        ),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )
