"""Line dedup, language ID, quality and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from bandstream.llm import language, linededup, quality

from .conftest import text_of, words


def plain_line_dedup(docs):
    """The rule, line by line."""
    seen, out = set(), {}
    for doc_id, text in docs:
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines = text.split("\n")
        h = [int(hashlib.md5(line.encode()).hexdigest()[:12], 16) for line in lines]
        chunks, start = [], 0
        for i in range(len(lines)):
            r = h[i] ^ (h[i - 1] << 1 if i > 0 else 0) ^ (h[i - 2] << 2 if i > 1 else 0)
            if (r >> 7) % 4 == 0 or i == len(lines) - 1:
                chunks.append(lines[start : i + 1])
                start = i + 1
        kept, removed = [], 0
        for chunk in chunks:
            body = "\n".join(chunk)
            if len(chunk) >= 2 and body in seen:
                removed += len(chunk)
                continue
            if len(chunk) >= 2:
                seen.add(body)
            kept += chunk
        out[doc_id] = ("\n".join(kept), len(lines), removed)
    return out


def line_docs():
    draw, blocks = random.Random(4), []
    for b in range(6):
        blocks.append([" ".join(words(60 * b + i, 4)) for i in range(draw.randint(2, 14))])
    docs = []
    for n in range(50):
        lines = [" ".join(words(5000 + 40 * n + i, 5)) for i in range(draw.randint(1, 10))]
        for b in draw.sample(range(6), draw.randint(0, 3)):
            lines += blocks[b] + [f"own {n} {b}"]
        docs.append((n, "\n".join(lines)))
    docs += [(60, docs[5][1]), (61, None), (62, ""), (63, "\n\n\n"), (64, "\n\n\n"), (65, "é\r\nx\n")]
    return docs


def test_line_dedup_against_the_rule_and_sql(spark, folder):
    docs = line_docs()
    folder.docs([(i, t, None, None, None) for i, t in docs])
    got = linededup.op3_line_dedup(spark, folder.path).collect()
    want = plain_line_dedup(docs)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == want
    assert sum(v[2] for v in want.values()) > 50
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder.path}/documents.parquet/*.parquet'")
    answer = {r[0]: (r[3], r[1], r[2]) for r in db.execute(linededup.SQL).fetchall()}
    assert answer == want


def test_an_inserted_line_moves_few_borders(spark):
    lines = [f"line number {i} {' '.join(words(i, 3))}" for i in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = linededup.deduplicated(docs).select("held.doc_id", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows}[2] >= 40


def test_stage_drops_what_has_no_text_left(spark, folder):
    folder.docs([(i, t, "en", "s", 1) for i, t in line_docs()])
    docs = spark.read.parquet(f"{folder.path}/documents.parquet")
    kept = {r["doc_id"]: r for r in linededup.stage(spark, docs, folder.path).collect()}
    want = plain_line_dedup(line_docs())
    assert set(kept) == {i for i, v in want.items() if not v[2] or v[0].strip()}
    assert all(r["text"] == want[i][0] for i, r in kept.items())
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept.items() if r["text"])


# --- language -----------------------------------------------------------------

WORDS = {
    "en": "the of and to in that with this from have which their would there".split(),
    "de": "der die und das nicht mit sich auch werden einer durch noch".split(),
    "fr": "le la les des une dans pour qui avec cette leur nous".split(),
}


def sentence(lang, n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def language_docs():
    rows = [(3 * i + k, sentence(lang, 40, 3 * i + k), lang, f"{lang}-host", 0)
            for i in range(80) for k, lang in enumerate(WORDS)]
    return rows


def test_text_alone(spark, folder):
    folder.docs(language_docs())
    got = {r["doc_id"]: r for r in language.op4_language_id(spark, folder.path).collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, *_ in language_docs())


def test_evidence_is_fused(spark, folder):
    """A text of one shared word follows its declaration or, without, its host."""
    rows = language_docs()
    rows += [(1000, "die", None, "fr-host", 0), (1001, "zz", "de", None, 0), (1002, "qx", None, "en-host", 0),
             (1003, sentence("fr", 60, 5), "en", "en-host", 0), (1004, "12 %% !!", "en", "en-host", 0)]
    docs = folder.docs(rows).spark.read.parquet(f"{folder.path}/documents.parquet")
    got = {r["doc_id"]: r for r in language.op4_language_id(spark, folder.path).collect()}
    assert got[1001]["language"] == "de"
    assert got[1002]["language"] == "en"
    assert got[1003]["language"] == "fr" and got[1003]["kept"]
    assert got[1004]["language"] == "und" and not got[1004]["kept"]
    kept = {r["doc_id"] for r in language.stage(spark, docs, folder.path).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_pages_use_markup_and_address(spark, folder):
    folder.docs(language_docs())
    pages = [(i, f"http://h{i % 5}.{lang}.example.com/{lang}/x",
              f"<html lang='{lang}'><script>var the=of;</script><p>{text}</p>")
             for i, text, lang, *_ in language_docs()]
    pages += [(999, "http://h1.fr.example.com/fr/y", "<html><p>zz</p>"), (998, None, None), (997, "x", "")]
    folder.put("pages", spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in language.page_languages(spark, folder.path).collect()}
    assert all(got[i]["language"] == lang for i, _, lang, *_ in language_docs())
    assert got[999]["language"] == "fr"
    assert got[998]["language"] == got[997]["language"] == "und"


# --- quality ------------------------------------------------------------------


def quality_docs():
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = text_of(i, 60)
        if not good:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_quality(spark, folder):
    rows, labels = quality_docs()
    folder.docs(rows).put(
        "labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    got = {r["doc_id"]: r for r in quality.op7_quality(spark, folder.path).collect()}
    good = np.array([got[i]["log_weight"] for i in range(1, 400, 2) if i % 4])
    bad = np.array([got[i]["log_weight"] for i in range(0, 400, 4)])
    assert (good[:, None] > bad[None]).mean() > 0.95
    share = sum(q for _, q, _ in labels) / len(labels)
    assert sum(r["selected"] for r in got.values()) == round(share * 400)


@pytest.mark.parametrize("k", [0, 1, 17, 150, 299, 300])
def test_draw_is_the_k_largest(spark, k):
    draw = random.Random(k)
    rows = [(i, round(draw.gauss(0, 1), 1), 0.0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double, noise double, tie long")
    got = {r["doc_id"] for r in quality.drawn(df, k).where("selected").collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    assert got == {r[0] for r in want}


def test_draw_follows_the_weights(spark):
    rows = [(i, float(i % 2) * np.log(4.0)) for i in range(4000)]
    drawn_rows = quality.weighed(
        spark.createDataFrame([(i, "") for i, _ in rows], "doc_id long, text string"), np.zeros(quality.BINS)
    ).withColumn("log_weight", (quality.F.col("doc_id") % 2) * float(np.log(4.0)))
    got = [r["doc_id"] for r in quality.drawn(drawn_rows, 400).where("selected").collect()]
    heavy = sum(i % 2 for i in got) / len(got)
    assert 0.74 < heavy < 0.86  # 4 : 1, a little less as heavy rows run out


# --- pipeline -----------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, folder):
    rows = [(i, sentence("en", 30, i) + " " + text_of(i, 60), "en", "s", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, "### 12", "en", "s", 0)]
    item = " ".join(words(424, 15))
    rows.append((102, text_of(77, 50) + " " + item, "en", "s", 0))
    folder.docs(rows).put("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder.path).collect()}
    assert set(out) == set(range(30))
    from bandstream.llm import bpe

    vocabulary = bpe.vocabulary(bpe.default_path())
    lines = plain_line_dedup([(r[0], r[1]) for r in rows])
    assert all(vocabulary.decode(bytes(r["ids"])) == lines[i][0] for i, r in out.items())
