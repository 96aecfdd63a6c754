"""Line dedup with content-defined chunks (operator 3).

A text is a list of lines.  A rolling hash over the hashes of the last ``WINDOW``
lines ends a chunk where it is divisible by ``EVERY``; so the borders depend on
nearby lines only, and an insertion moves them no further.  Chunks of two or more
lines that occur again anywhere are removed, but for the first occurrence (lowest
doc_id, nulls last, then lowest position).  Chunks that share a hash are compared
byte by byte (grouped by their text) before anything is removed.

Only hashes of chunks cross the first shuffle, combined per task; the text of
chunks whose hash repeats the second.  A chunk that a third of all documents has
is one row per task in both.  Everything is DataFrame functions.

Single lines are never removed.  A null text stays null and an empty one stays
empty.  Rows with the same doc_id and text are one document: what is removed from
one of them is removed from all.  Lines end at a line feed; other characters
belong to the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandstream.functions.staging import compute_once
from bandstream.llm.common import doc_key, stored, table

WINDOW = 3
EVERY = 4
SHORTEST = 2


def line_hash(line: Column) -> Column:
    """48 bits of the MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 12), 16, 10).cast("long")


def rolling(hashes: Column, i: Column) -> Column:
    """Hashes of the lines up to ``i``, older ones shifted further."""
    at = lambda k: F.when(i >= k, F.get(hashes, i - k)).otherwise(F.lit(0).cast("long"))
    out = at(0)
    for k in range(1, WINDOW):
        out = out.bitwiseXOR(F.shiftleft(at(k), k))
    return out


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds k1, k2 (the row's key), lines and chunks: (n, first, size) in order."""
    k1, k2 = doc_key("doc_id", text)
    lines = F.when(F.col(text).isNotNull(), F.split(text, "\n", -1)).otherwise(
        F.array().cast("array<string>")
    )
    rows = compute_once(docs, {"k1": k1, "k2": k2, "lines": lines})
    rows = compute_once(rows, {"hashes": F.transform("lines", line_hash)})
    last = F.size("lines") - 1
    border = lambda i: (i == last) | (
        F.pmod(F.shiftright(rolling(F.col("hashes"), i), 7), F.lit(EVERY)) == 0
    )
    ends = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), border)).otherwise(
        F.array().cast("array<int>")
    )
    rows = compute_once(rows, {"ends": ends})
    start = lambda i: F.when(i > 0, F.get("ends", i - 1) + 1).otherwise(F.lit(0))
    chunks = F.transform(
        "ends",
        lambda end, i: F.struct(
            i.alias("n"), start(i).alias("first"), (end - start(i) + 1).alias("size")
        ),
    )
    return compute_once(rows, {"chunks": chunks}).drop("hashes", "ends")


def long_chunks(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n, body and hash of every chunk of two or more lines."""
    long_ones = F.filter("chunks", lambda c: c["size"] >= SHORTEST)
    rows = chunked(docs.select("doc_id", "text")).select(
        "k1", "k2", "doc_id", "lines", F.explode(long_ones).alias("c")
    )
    body = F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.size")), "\n")
    rows = rows.select("k1", "k2", "doc_id", F.col("c.n").alias("n"), body.alias("body"))
    return compute_once(rows, {"hash": F.xxhash64("body")})


def removals(docs: DataFrame) -> DataFrame:
    """k1, k2 and the numbers of the chunks to remove."""
    seen = long_chunks(docs).groupBy("hash").agg(F.count("*").alias("times"))
    again = stored(seen.where("times > 1").select("hash"), "repeated")
    members = stored(long_chunks(docs).join(again, "hash", "left_semi"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "n")
    firsts = members.groupBy("hash", "body").agg(
        F.min(place).alias("first"), F.count("*").alias("times")
    )
    # stored, so that the join has two plain shuffles and a hot chunk can be split
    firsts = stored(firsts.where("times > 1"), "firsts").hint("merge")
    later = members.join(firsts, ["hash", "body"]).where(
        (F.col("k1") != F.col("first.k1"))
        | (F.col("k2") != F.col("first.k2"))
        | (F.col("n") != F.col("first.n"))
    )
    return later.groupBy("k1", "k2").agg(F.collect_set("n").alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without repeated chunks, and n_lines and n_removed."""
    gone = stored(removals(docs), "removals").withColumnsRenamed({"k1": "r1", "k2": "r2"})
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    k1, k2 = doc_key("doc_id", "text")
    rows = docs.select("doc_id", "text", rest.alias("held"), k1.alias("j1"), k2.alias("j2"))
    # the texts cross the shuffle once, and are cut into lines behind it; the hint
    # keeps the plan the same at every size
    found = rows.join(
        gone.hint("merge"), (F.col("j1") == F.col("r1")) & (F.col("j2") == F.col("r2")), "left"
    )
    joined = chunked(found.select("doc_id", "text", "held", "removed"))
    keep = F.filter("chunks", lambda c: ~F.array_contains("removed", c["n"]))
    kept = F.flatten(
        F.transform(keep, lambda c: F.slice(F.col("lines"), c["first"] + 1, c["size"]))
    )
    lost = F.filter("chunks", lambda c: F.array_contains("removed", c["n"]))
    return joined.select(
        "held",
        F.when(F.col("removed").isNull(), F.col("text"))
        .otherwise(F.array_join(kept, "\n"))
        .alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), F.lit(0).cast("long"))
        .otherwise(F.aggregate(lost, F.lit(0), lambda a, c: a + c["size"]).cast("long"))
        .alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("held.doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shorter texts; what has no text left but had some goes."""
    out = deduplicated(docs).where(
        (F.col("n_removed") == 0) | (F.length(F.trim(F.col("text"))) > 0)
    )
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(
        *[
            own[c].cast(docs.schema[c].dataType).alias(c)
            if c == "text" or c == "n_chars"
            else F.col("held")[c].alias(c)
            for c in docs.columns
        ]
    )


SQL = """
WITH lines AS (
    SELECT doc_id, i, string_split(text, chr(10))[i] AS line,
        len(string_split(text, chr(10))) AS n
    FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
),
hashed AS (
    SELECT *, ('0x' || substr(md5(line), 1, 12))::BIGINT AS h FROM lines
),
rolled AS (
    SELECT *, xor(xor(h, lag(h, 1, 0::BIGINT) OVER w << 1), lag(h, 2, 0::BIGINT) OVER w << 2) AS r
    FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT *, coalesce(sum(((r >> 7) % 4 = 0)::INT) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
    FROM rolled
),
chunks AS (
    SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS size
    FROM numbered GROUP BY doc_id, c
),
ranked AS (
    SELECT *, size >= 2 AND row_number() OVER (
        PARTITION BY size >= 2, body ORDER BY doc_id, c) > 1 AS gone
    FROM chunks
),
rebuilt AS (
    SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text,
        sum(size)::BIGINT AS n_lines,
        coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed
    FROM ranked GROUP BY doc_id
)
SELECT doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, r.text
FROM documents LEFT JOIN rebuilt r USING (doc_id)
"""
