"""Quality by importance resampling (operator 7).

Two generative models of hashed word n-grams, one of the target (documents that
``labels`` calls good) and one of the raw corpus (every document), give each
document an importance weight: the log of how much more likely the target model
is to produce it.  Adding a Gumbel variable to every log weight and taking the
``k`` largest sums draws ``k`` documents without replacement in proportion to
their weights.

* Words and word pairs are hashed into ``BINS`` bins.  Tasks add up their own
  documents, so what is shuffled is one number per bin and task.
* The log weight is the mean over the n-grams of a document times ``SHARPNESS``:
  a plain sum would grow with length and draw long documents only.
* The raw model counts all documents.  The target model is fitted on at most
  ``FIT_ROWS`` labelled documents, chosen by a hash of doc_id.
* The noise comes from a hash of doc_id and text, so a repeated task draws the
  same.  The k-th largest key is found by counting keys in ever finer ranges; no
  task ever sorts all of them.

Null and empty texts have no n-grams and log weight 0.  Ties at the k-th key are
settled by doc_id (nulls last), then by the text hash; rows that are still equal
are drawn together, so a draw can exceed ``k`` by such copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import fields, stored, table, text_bytes

BINS = 1 << 16
FIT_ROWS = 10_000
SHRINK = 20.0
SHARPNESS = 100.0
SEED = 1729
SHARES = 1 << 30
#: Ranges per counting pass: 2**16.
STEP = 16


def ngram_bins(text: bytes) -> np.ndarray:
    """Bins of the words and word pairs of a lower-cased text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    one = np.array([digest(w) for w in words], dtype=np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two = (two ^ (two >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two]) >> np.uint64(48)).astype(np.int64)


def bin_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bin in ``docs``."""

    def run(batches):
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(ngram_bins(text), minlength=BINS)
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bins.astype(np.int32)), pa.array(total[bins])], ["bin", "n"]
        )

    parts = docs.select(text_bytes().alias("raw")).mapInArrow(run, "bin int, n long")
    out = np.zeros(BINS, dtype=np.float64)
    for row in parts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        out[row["bin"]] = row["n"]
    return out


def target_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` of the documents whose label is good."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    share = min(1.0, 2 * rows / max(1, good.count()))
    ids = good.where(F.col("h") < int(share * SHARES)).orderBy("h", "doc_id").limit(rows)
    ids = stored(ids.select("doc_id"), "target")
    # at most FIT_ROWS ids
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target share over raw share per bin, shrunk for rare bins.

    The target is a part of the corpus: without ``SHRINK`` expected occurrences
    added on both sides, rare words of the fitted documents would tell them from
    equally good ones.
    """
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + SHRINK) / (expected + SHRINK))


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, noise and tie (a hash of the text) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            weights, noise, ties = [], [], []
            for key, text in zip(batch.column(2).to_pylist(), texts):
                bins = ngram_bins(text)
                weights.append(float(shared.value[bins].mean()) * SHARPNESS if len(bins) else 0.0)
                tie = xxhash.xxh3_64_intdigest(text, seed)
                drawn = xxhash.xxh3_64_intdigest(f"{key}:{tie}".encode(), seed)
                noise.append(-np.log(-np.log((drawn + 0.5) / 2.0**64)))
                ties.append(tie >> 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(weights, pa.float64()),
                    pa.array(noise, pa.float64()),
                    pa.array(ties, pa.int64()),
                ],
                ["doc_id", "log_weight", "noise", "tie"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_bytes().alias("raw"), F.col("doc_id").cast("string").alias("k"))
    return rows.mapInArrow(
        run, fields(f"doc_id {kind}, log_weight double, noise double, tie long")
    )


def drawn(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``selected``: the ``k`` rows with the largest log_weight + noise.

    The key as a whole number of 48 bits is looked at 16 bits at a time: the
    range with the k-th largest is counted in turn, at most 65536 counts each.
    """
    keyed = rows.withColumn("key", F.col("log_weight") + F.col("noise"))
    ends = keyed.agg(F.min("key"), F.max("key")).first()
    low, high = (ends[0] or 0.0), (ends[1] or 0.0)
    width = max(high - low, 1e-12)
    whole = ((F.col("key") - F.lit(low)) / F.lit(width) * F.lit(float((1 << 48) - 1))).cast("long")
    keyed = stored(keyed.withColumn("rank_key", whole), "keys")
    prefix, left = 0, k
    for shift in (32, 16, 0):
        part = F.shiftright("rank_key", shift)
        here = keyed.where(F.shiftright("rank_key", shift + STEP) == prefix)
        counts = here.groupBy(part.alias("p")).count().collect()  # at most 2 ** 16 rows
        at = prefix << STEP
        for p, n in sorted(((r["p"], r["count"]) for r in counts), reverse=True):
            at = p
            if n >= left:
                break
            left -= n
        prefix = at
    edge = keyed.where(F.col("rank_key") == prefix)
    order = [F.col("key").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    cut = edge.orderBy(*order).offset(max(left - 1, 0)).limit(1).first() if left > 0 else None
    chosen = F.col("rank_key") > prefix
    if cut:
        doc, last = F.col("doc_id"), F.lit(cut["doc_id"])
        same_doc = doc.eqNullSafe(last)
        before = F.coalesce(doc < last, doc.isNotNull() & last.isNull())
        at_cut = before | (same_doc & (F.col("tie") <= cut["tie"]))
        key = F.col("key")
        on_edge = (key > cut["key"]) | ((key == cut["key"]) & at_cut)
        chosen = chosen | ((F.col("rank_key") == prefix) & on_edge)
    return keyed.select(*rows.columns, chosen.alias("selected"))


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight and selected of every document.

    ``share`` of them is drawn, by default the share of good ones among the labels.
    """
    if share is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    ratio = log_ratio(bin_counts(target_documents(docs, labels)), bin_counts(docs))
    rows = stored(weighed(docs, ratio), "weights")
    out = drawn(rows, int(round(share * rows.count())))
    return out.select("doc_id", "log_weight", "selected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
