"""URL rules by host-suffix and path-prefix expressions, DataFrame functions only.

Each URL is expanded into the expressions (host suffix, path prefix) that a rule could have; those are joined with the
rules on a short prefix of a SHA-256 digest, full digests confirm, and the longest rule that is left decides.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits; repeated rows are
judged once per row; columns other than the id and the URL are ignored; an empty table gives an empty table. Of two
rules for one expression, block wins.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hex digits of a digest that the join is on.
SHORT = 8
#: Rules that are sent to every executor at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Parts that a hot expression is spread over in that shuffle.
SALTS = 16


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict``; ``rule`` is the deciding host and path, null where none fits.

    Only shapes (labels of the host, characters of the path) that some rule has are expanded. They go into the plan as
    one constant, a list of path lengths for each number of labels; hosts have some dozens of labels at most and paths
    some thousands of characters, which bounds it whatever the number of rules. Rows of the same id and URL are counted before the
    expansion, so a hot URL is expanded once for each id; nothing is grouped by host or expression.
    """
    rules = rules.where("host is not null and path is not null").select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.sha2(F.concat("host", "path"), 256).alias("full"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length("path").alias("chars"),
    )
    rules = rules.groupBy("full", "rule", "labels", "chars").agg(F.max("verdict").alias("verdict"))
    shapes = {r.labels: sorted(r.chars) for r in rules.groupBy("labels").agg(F.collect_set("chars").alias("chars")).collect()}
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    rules = rules.select(F.substring("full", 1, SHORT).alias("short"), "full", "rule", "verdict")

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.groupBy("id", "url").agg(F.count("*").alias("n"))
    rows = rows.select("id", "url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.", -1)
    lengths = F.from_json(F.lit(json.dumps([shapes.get(n + 1, []) for n in range(max(shapes, default=0))])), "array<array<int>>")

    def expressions(labels: Column) -> Column:
        fit = F.filter(F.coalesce(F.try_element_at(lengths, labels), F.array().cast("array<int>")), lambda n: n <= F.length("path"))
        host = F.array_join(F.slice(parts, -labels, labels), ".")
        return F.transform(fit, lambda n: F.sha2(F.concat(host, F.substring("path", F.lit(1), n)), 256))

    made = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), expressions))
    # The null keeps URLs that have no expression at all.
    full = F.array_append(F.when(F.length("host") > 0, made).otherwise(F.array().cast("array<string>")), F.lit(None))
    rows = rows.select("id", "url", "n", "host", "path", F.explode(full).alias("full"))
    rows = rows.withColumn("short", F.substring("full", 1, SHORT))
    if few:
        hit = rows.join(F.broadcast(rules.withColumnRenamed("full", "rule_full")), "short", "left")
    else:
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS).cast("long"))
        salted = rules.withColumnRenamed("full", "rule_full").select("*", F.expr(f"explode(sequence(0L, {SALTS - 1}L)) as salt"))
        hit = rows.withColumn("salt", salt).join(salted, ["short", "salt"], "left")
    best = F.when(F.col("full") == F.col("rule_full"), F.struct(F.length("rule").alias("size"), "rule", "verdict"))
    hit = hit.groupBy("id", "url").agg(F.first("n").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(best).alias("best"))
    return hit.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"),
    ).drop("_copy")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM parts
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hosts LEFT JOIN best USING (n)
"""
