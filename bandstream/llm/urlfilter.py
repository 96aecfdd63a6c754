"""URL filters by a sort-merge range join (operator 2).

A host with its labels reversed, ``www.example.org`` as ``org,example,www,``,
starts with the key of every rule host it belongs to, so a rule is an interval of
keys.  Intervals of prefixes are nested or apart.  Keys and rules are sorted
together; each rule carries the *stack* of rules that are active from it on (the
rules that contain it, and itself), the sweep hands the last stack on, and what
the key has left behind is popped by a comparison.  A second sweep of the same
kind, over rule host and path, finds the nested path rules.

The sort is range partitioned by key and row, so that a host with any share of
the rows is spread over many tasks; the stack that reaches the end of a range is
handed to the following ranges.  Rules and rows meet nowhere else, so the size of
neither side matters.

A null url or one without ``://`` has an empty host and path, and no rule fits.
Rules whose host is null or empty never fit; a null path is an empty one.  The
longest rule (host plus path, then the longer host) wins; of equal rules that
block and allow, the block wins.  Without a rule the verdict is the method's,
``allow``.  Repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandstream.llm.common import stored, table

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a comma."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def covers(rule_host: Column, host: Column) -> Column:
    """The host is the rule's or one below it."""
    return (host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))


def sweep(rows: DataFrame, rules: DataFrame, key: str, tie: str, stack: str) -> DataFrame:
    """Add ``stack``: the last one of ``rules`` (``key``, ``stack``) at or before ``key``.

    ``tie`` tells rows of one key apart; ``key`` is unique among the rules.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rules.schema[stack].dataType
    events = rows.withColumns({stack: F.lit(None).cast(kind), "_row": F.lit(1)}).unionByName(
        rules.select(key, stack).withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    # written, because the borders of the ranges must be the same for both readers
    dealt = stored(
        events.repartitionByRange(n, key, "_row", tie).withColumn("_part", F.spark_partition_id()),
        "sweep",
    )
    ends = dealt.groupBy("_part").agg(
        F.max_by(stack, F.when(F.col("_row") == 0, F.col(key))).alias("_end")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_in"))
    so_far = (
        Window.partitionBy("_part")
        .orderBy(key, "_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = dealt.withColumn(stack, F.last(stack, ignorenulls=True).over(so_far))
    swept = swept.where("_row = 1").join(carried, "_part")
    return swept.withColumn(stack, F.coalesce(stack, "_in")).drop("_in", "_part", "_row")


def host_stacks(rules: DataFrame) -> DataFrame:
    """(key, hosts): for each rule host all rule hosts that contain it."""
    hosts = rules.select("rule_host").distinct().withColumn("key", host_key(F.col("rule_host")))
    labels = F.split("rule_host", r"\.")
    above = hosts.select(
        "key",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
            )
        ).alias("rule_host"),
    )
    known = hosts.select("rule_host")
    return above.join(known, "rule_host").groupBy("key").agg(
        F.collect_set("rule_host").alias("hosts")
    )


def path_stacks(rules: DataFrame) -> DataFrame:
    """(key, nested): for each rule all rules of its host whose paths contain it."""
    starts = rules.select(
        "rule_host",
        "rule_path",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("rule_path")),
                lambda i: F.substring(F.col("rule_path"), F.lit(1), i),
            )
        ).alias("_start"),
    )
    inner = rules.select(
        "rule_host", F.col("rule_path").alias("_start"), F.col("action").alias("_action")
    )
    return (
        starts.join(inner, ["rule_host", "_start"])
        .groupBy("rule_host", "rule_path")
        .agg(F.collect_set(F.struct(F.col("_start").alias("path"), "_action")).alias("nested"))
        .select(
            F.concat(host_key(F.col("rule_host")), "rule_path").alias("key"),
            F.transform(
                "nested",
                lambda r: F.struct(
                    F.col("rule_host").alias("host"),
                    r["path"].alias("path"),
                    r["_action"].alias("action"),
                ),
            ).alias("nested"),
        )
        # keys of different hosts can only coincide for hosts with odd characters
        .groupBy("key")
        .agg(F.flatten(F.collect_list("nested")).alias("nested"))
    )


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row per (rule_host, rule_path); ``block`` sorts after ``allow``."""
    return (
        rules.select(
            F.translate("host", UPPER, LOWER).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            "action",
        )
        .where("rule_host != ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
    )


def url_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``urls`` (page_id, url).

    ``rules``: action (allow or block), host, path.
    """
    rules = clean_rules(rules)
    rows = urls.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumns({"_id": F.monotonically_increasing_id(), "key": host_key(F.col("host"))})
    active = sweep(rows, host_stacks(rules), "key", "_id", "hosts")
    popped = F.filter("hosts", lambda h: covers(h, F.col("host")))
    active = stored(active.withColumn("hosts", popped).drop("key"), "hosts")
    asked = active.select(
        "_id", "page_id", "host", "path", F.explode_outer("hosts").alias("rule_host")
    )
    keyed = asked.withColumn("key", F.concat(host_key(F.col("rule_host")), "path"))
    nested = sweep(keyed.where("rule_host IS NOT NULL"), path_stacks(rules), "key", "_id", "nested")
    fits = F.filter(
        "nested",
        lambda r: (r["host"] == F.col("rule_host")) & F.col("path").startswith(r["path"]),
    )
    longest = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                (F.length(r["host"]) + F.length(r["path"])).alias("size"),
                F.length(r["host"]).alias("host_size"),
                F.concat(r["host"], r["path"]).alias("rule"),
                r["action"].alias("action"),
            ),
        )
    )
    found = nested.select("_id", "page_id", "host", "path", longest.alias("best"))
    none = asked.where("rule_host IS NULL").select(
        "_id", "page_id", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best")
    )
    best = found.unionByName(none).groupBy("_id").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max("best").alias("best"),
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"),
    )


RULES = """
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
        ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM ({RULES}) AS r(action, host, path)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH rules AS (SELECT * FROM ({RULES}) AS r(action, rule_host, rule_path)),
split AS (
    SELECT row_number() OVER () AS id, page_id,
        translate(
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
        ) AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
),
fits AS (
    SELECT s.id, r.action, r.rule_host || r.rule_path AS rule
    FROM split s JOIN rules r
        ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host))
        AND starts_with(s.path, r.rule_path)
),
best AS (
    SELECT id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
    FROM fits GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM split LEFT JOIN best USING (id)
"""
