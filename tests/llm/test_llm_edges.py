"""Every operator and stage on odd and on empty tables."""

import pytest

import corpus_pipeline
from bandstream.llm import queries

DOCUMENT_QUERIES = [
    n for n in queries.QUERIES if n not in ("op2_url_filter", "op5_neighbours", "page_languages")
]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty.path).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty.path).collect() == []


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_documents(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd.path).collect()
    if name == "op13_packing":
        assert sum(r["piece"] == 0 for r in rows) == 12 < len(rows)
    elif name not in ("op1_decontaminate", "op8_repeated_passages"):
        assert len(rows) == 12


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_stages(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd.path}/documents.parquet")
    out = stage(spark, docs, odd.path)
    rows = out.collect()
    assert len(rows) <= 12
    if name != "tokens":
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    else:
        assert len(rows) == 12


def test_odd_results(spark, odd):
    """The results the docstrings promise."""
    by = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, odd.path).collect()}
    bpe = by("op9_bpe")
    assert bpe[900]["n_tokens"] == 0 and bpe[901]["n_tokens"] == 0
    prints = by("op6_simhash")
    empty = {900, 901, 902}
    assert {prints[i]["fingerprint"] for i in empty} == {"0" * 16}
    assert {prints[i]["component_id"] for i in empty} == {900}
    lines = by("op3_line_dedup")
    assert lines[901]["text"] is None and lines[901]["n_lines"] == 0
    assert lines[900]["text"] == "" and lines[900]["n_removed"] == 0
    languages = by("op4_language_id")
    assert not languages[900]["kept"] and languages[900]["language"] == "und"
    quality = by("op7_quality")
    assert quality[901]["log_weight"] == 0.0
    assert by("op10_secrets")[901]["spans"] == ""
    aligned = by("op11_alignment")
    assert aligned[900]["groups_sha256"] == aligned[901]["groups_sha256"] == ""
    assert aligned[903]["n_a"] > 0 and aligned[901]["n_links"] == 0
    leaves = by("op12_merkle")
    assert len({r["root"] for r in leaves.values()}) == 1
    assert leaves[901]["verified"] and leaves[901]["subroot"] == leaves[900]["subroot"]
    packed = by("op13_packing")
    assert packed[900]["length"] == packed[901]["length"] == packed[902]["length"] == 1


def test_near_dedup_keeps_one_of_equal_rows(spark, odd):
    docs = spark.read.parquet(f"{odd.path}/documents.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, odd.path).collect()]
    assert ids.count(903) == 1 and ids.count(900) == 1
    assert 901 not in ids and 902 not in ids
