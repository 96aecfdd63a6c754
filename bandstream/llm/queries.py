"""The registered queries of this package and their SQL."""

from __future__ import annotations

from bandstream.llm import (
    alignment,
    bpe,
    decontaminate,
    language,
    linededup,
    merkle,
    neighbours,
    packing,
    quality,
    secrets,
    simhash,
    suffixes,
    urlfilter,
)

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate,
        urlfilter.op2_url_filter,
        linededup.op3_line_dedup,
        language.op4_language_id,
        language.page_languages,
        neighbours.op5_neighbours,
        simhash.op6_simhash,
        quality.op7_quality,
        suffixes.op8_repeated_passages,
        bpe.op9_bpe,
        secrets.op10_secrets,
        alignment.op11_alignment,
        merkle.op12_merkle,
        packing.op13_packing,
    )
}

SQL = {
    "op2_url_filter": urlfilter.SQL,
    "op3_line_dedup": linededup.SQL,
}
