"""Language ID by Bayesian evidence fusion (operator 4).

Every row has up to four kinds of evidence: its text, the language it declares,
the suffix of its address and the host it comes from.  The posterior of a
language is the product of

* the likelihood of the text: hashed character trigrams, at most ``EVIDENCE`` of
  them counted in full (trigrams of a text are far from independent);
* the likelihood of the declaration and of the suffix, learned from how often
  texts of each language carry them;
* a host prior, smoothed towards its parent domain, smoothed towards the whole.

The last two come from grouped counts over all rows: how often the text alone
points to each language per declaration, suffix, host and parent.  A row's own
vote is taken out of its host prior.

``und`` stands beside the languages: every trigram equally likely.  A row without
letters, or whose best language is ``und`` or has less than half of the
posterior, is rejected.  Null texts are empty texts, a missing declaration,
suffix, host or parent is no evidence.  Of equal posteriors the first language in
alphabetical order wins.  Rows with equal evidence get equal results.

Only the trigram model is fitted on a sample: at most ``FIT_ROWS`` labelled rows,
by hash of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.llm.common import doc_key, fields, fresh, stored, table, text_bytes
from bandstream.llm.urlfilter import host_of, path_of

BINS = 1 << 15
FIT_ROWS = 4000
FIT_CHARS = 20_000
SHARES = 1 << 30
EVIDENCE = 40
SMOOTH = 0.1
PRIOR_WEIGHT = 10.0
NONE = "und"
LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of the lower-case words, spaces included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = LETTERS[np.minimum(codes, (1 << 16) - 1)]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1)
    mixed = (mixed ^ codes[1:-1]) * np.uint32(0x85EBCA77)
    mixed = (mixed ^ codes[2:]) * np.uint32(0xC2B2AE3D)
    return (mixed >> np.uint32(17)).astype(np.int64)


@dataclass
class TrigramModel:
    languages: list[str]
    log_share: np.ndarray

    @classmethod
    def fit(cls, rows) -> "TrigramModel":
        """From (language, text) pairs."""
        counts: dict[str, np.ndarray] = {}
        for language, text in rows:
            held = counts.setdefault(language, np.zeros(BINS))
            held += np.bincount(trigrams(text), minlength=BINS)
        names = sorted(counts)
        table = np.array([counts[n] for n in names]).reshape(-1, BINS) + SMOOTH
        shares = np.log(table / table.sum(axis=1, keepdims=True))
        flat = np.full((1, BINS), -np.log(BINS))
        return cls([*names, NONE], np.concatenate([shares, flat]).T.astype(np.float32))

    def score(self, text: str) -> tuple[list[float], int]:
        """Log-likelihoods per language and the number of trigrams."""
        bins = trigrams(text)
        if not len(bins):
            return [0.0] * len(self.languages), 0
        total = np.zeros(len(self.languages))
        for at in range(0, len(bins), 65_536):
            total += self.log_share[bins[at : at + 65_536]].sum(axis=0, dtype=np.float64)
        return (total * min(1.0, EVIDENCE / len(bins))).tolist(), len(bins)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> TrigramModel:
    """From at most ``rows`` rows of (language, text), chosen by text hash.

    Longer texts than ``FIT_CHARS`` do not take part in the fit.
    """
    usable = labelled.where(
        f"language IS NOT NULL AND language != '{NONE}' AND length(text) BETWEEN 1 AND {FIT_CHARS}"
    ).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(SHARES)))
    share = min(1.0, 2 * rows / max(1, usable.count()))
    sample = usable.where(F.col("h") < int(share * SHARES)).orderBy("h", "language").limit(rows)
    return TrigramModel.fit((r[0], r[1]) for r in sample.select("language", "text").collect())


def scored(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """``rows`` with ``scores`` (one per language) and ``size`` in place of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = [shared.value.score(t.decode()) for t in texts]
            scores = pa.array([m[0] for m in made], pa.list_(pa.float64()))
            sizes = pa.array([m[1] for m in made], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], scores, sizes], [*rest, "scores", "size"]
            )

    schema = fields("")
    for field in [*rows.select(*rest).schema, *fields("scores array<double>, size int")]:
        schema.add(field)
    return rows.select(*rest, text_bytes().alias("text")).mapInArrow(run, schema)


def best_of(scores: Column) -> Column:
    """Index of the first largest score."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def votes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key how many texts point to each language."""
    counts = [F.count_if(F.col("vote") == i).cast("double") for i in range(n)]
    return rows.groupBy(*keys).agg(F.array(*counts).alias("votes"))


def likelihoods(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Per value of ``key`` the log-probability that a text of each language has it."""
    counts = votes(rows.where(F.col(key).isNotNull()), [key], n)
    totals = counts.agg(*[F.sum(F.col("votes")[i] + 1) for i in range(n)]).first()  # n numbers
    logs = [F.log((F.col("votes")[i] + 1) / F.lit(totals[i] or 1.0)) for i in range(n)]
    return counts.select(key, F.array(*logs).alias(f"{key}_log"))


def smoothed(counts: Column, prior: Column) -> Column:
    """Counts plus ``PRIOR_WEIGHT`` votes spread like ``prior``, as shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.zip_with(
        counts, prior, lambda c, p: (c + PRIOR_WEIGHT * p) / (total + F.lit(PRIOR_WEIGHT))
    )


def identified(rows: DataFrame, model: TrigramModel, label: str = "language") -> DataFrame:
    """Adds language, posterior and kept to rows of (text, declared, suffix, host, parent, ...).

    The other columns are passed through, the text is not.
    """
    names = model.languages
    n = len(names)
    own = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host", "parent")]
    vote = F.when(F.col("size") > 0, best_of(F.col("scores")))
    held = stored(scored(rows, model).withColumn("vote", vote), "scores")
    voting = held.where("vote IS NOT NULL")
    declared = stored(likelihoods(voting, "declared", n), "declared")
    suffix = stored(likelihoods(voting, "suffix", n), "suffix")
    per_host = stored(votes(voting, ["host", "parent"], n), "hosts")
    per_parent = stored(
        per_host.where("parent IS NOT NULL")
        .groupBy("parent")
        .agg(F.array(*[F.sum(F.col("votes")[i]) for i in range(n)]).alias("parent_votes")),
        "parents",
    )
    everywhere = per_host.agg(*[F.sum(F.col("votes")[i]) for i in range(n)]).first()  # n numbers
    all_votes = F.array(*[F.lit(float(v or 0)) for v in everywhere])
    even = F.array(*[F.lit(1.0 / n)] * n)
    zero = F.array(*[F.lit(0.0)] * n)
    joined = (
        held.join(declared, "declared", "left")
        .join(suffix, "suffix", "left")
        .join(
            per_host.where("host IS NOT NULL").groupBy("host").agg(
                F.array(*[F.sum(F.col("votes")[i]) for i in range(n)]).alias("host_votes")
            ),
            "host",
            "left",
        )
        .join(per_parent, "parent", "left")
    )
    mine = lambda votes: F.transform(
        F.coalesce(votes, zero), lambda v, i: F.when(F.col("vote") == i, v - 1).otherwise(v)
    )
    floor = lambda votes: F.transform(mine(votes), lambda v: F.greatest(v, F.lit(0.0)))
    prior = smoothed(
        floor(F.col("host_votes")),
        smoothed(floor(F.col("parent_votes")), smoothed(floor(all_votes), even)),
    )
    total = F.col("scores")
    for part in ("declared_log", "suffix_log"):
        total = F.zip_with(total, F.coalesce(part, zero), lambda a, b: a + b)
    total = F.zip_with(total, F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b)
    fused = joined.withColumn("prior", prior).withColumn("total", total)
    top = F.array_max("total")
    weight = F.aggregate("total", F.lit(0.0), lambda a, t: a + F.exp(t - top))
    best = F.get(F.array(*[F.lit(name) for name in names]), best_of(F.col("total")))
    answer = fused.select(
        *own,
        F.when(F.col("size") > 0, best).otherwise(F.lit(NONE)).alias(label),
        F.when(F.col("size") > 0, 1 / weight).otherwise(F.lit(0.0)).alias("posterior"),
    )
    return answer.withColumn("kept", (F.col(label) != NONE) & (F.col("posterior") >= 0.5))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents declare ``lang`` and come from ``source``; they have no address."""
    nothing = F.lit(None).cast("string")
    declared = F.col("lang") if "lang" in docs.columns else nothing
    host = F.col("source") if "source" in docs.columns else nothing
    k1, k2 = doc_key("doc_id", "text")
    return docs.select(
        "doc_id",
        k1.alias("k1"),
        k2.alias("k2"),
        "text",
        F.lower(declared).alias("declared"),
        nothing.alias("suffix"),
        host.cast("string").alias("host"),
        nothing.alias("parent"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages declare ``<html lang>``; the suffix is the top domain and a language path."""
    html, host = F.col("html"), host_of(F.col("url"))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    labels = F.split(host, r"\.")
    section = F.lower(F.regexp_extract(path_of(F.col("url")), r"^/([A-Za-z]{2})(/|$)", 1))
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    given = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id",
        text.alias("text"),
        given(declared).alias("declared"),
        F.when(host != "", F.concat_ws("/", F.element_at(labels, -1), given(section))).alias("suffix"),
        given(host).alias("host"),
        given(parent).alias("parent"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lower("lang").alias("language"), "text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled_documents(spark, sf_dir))
    rows = document_rows(table(spark, sf_dir, "documents"))
    return identified(rows.drop("k1", "k2"), model)


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages, where all four kinds of evidence occur."""
    model = fit(labelled_documents(spark, sf_dir))
    return identified(page_rows(table(spark, sf_dir, "pages")), model)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; the others stay as they are."""
    model = fit(docs.select(F.lower("lang").alias("language"), "text"))
    verdicts = identified(document_rows(docs), model)
    gone = stored(verdicts.where("NOT kept").select("k1", "k2").distinct(), "rejected")
    k1, k2 = fresh(docs, "k1", "k2")
    one, two = doc_key("doc_id", "text")
    keyed = docs.withColumns({k1: one, k2: two})
    return keyed.join(gone.toDF(k1, k2), [k1, k2], "left_anti").select(*docs.columns)
