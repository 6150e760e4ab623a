"""Operator 7, URL filters: host-suffix and path-prefix rules, found by hash-prefix equi-join.

Each distinct URL is expanded into the (host suffix, path prefix) expressions whose shapes occur among the rules; their
SHA-256 digests meet the rules' digests by an equi-join on a short prefix, the full digest confirms, and the longest
rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import ascii_lower, stored, table

#: Hex digits of a digest that the join runs on.
PREFIX = 8
#: Stands between host and path in what is digested, so that their border counts.
GAP = "\0"
#: The query's rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    each = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*each))) if rules else spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in ("host", "path", "verdict")])


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each distinct non-null URL that a rule fits: ``url``, ``rule``, ``verdict``.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest ``host || path``
    wins, then the longer host, then block over allow. Rules with a null part are left out; a rule may repeat. The
    shapes (labels of the host, characters of the path) are the rules' own, so a URL expands into as many expressions
    as there are shapes at most, however long it is; shapes number labels times path lengths of the rules, not rules, and
    only they reach the driver. The rules are joined, not collected; Spark broadcasts them only
    when their measured size is below its threshold.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    labels_of = lambda host: F.split(host, r"\.")
    shapes = [(r.k, r.n) for r in rules.select(F.size(labels_of(F.col("host"))).alias("k"), F.length("path").alias("n")).distinct().collect()]
    kept = (
        rules.withColumn("digest", F.sha2(F.concat("host", F.lit(GAP), "path"), 256))
        .groupBy("host", "path", "digest")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.substring("digest", 1, PREFIX).alias("prefix"),
            F.expr(f"substring(digest, {PREFIX + 1})").alias("rest"),
            F.length("host").alias("host_chars"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        )
    )
    parts = (
        pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
        .select("url", labels_of(host_of(F.col("url"))).alias("labels"), path_of(F.col("url")).alias("path"))
    )
    shape = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(shapes)]) if shapes else F.expr("cast(array() as array<struct<k:int,n:int>>)")
    fitting = F.filter(shape, lambda s: (s.k <= F.size("labels")) & (s.n <= F.length("path")))
    expression = lambda s: F.concat(F.array_join(F.slice("labels", F.size("labels") - s.k + 1, s.k), "."), F.lit(GAP), F.substring("path", 1, s.n))
    asked = parts.select("url", F.explode(F.transform(fitting, expression)).alias("expression")).withColumn("digest", F.sha2("expression", 256))
    asked = asked.select("url", F.substring("digest", 1, PREFIX).alias("prefix"), F.expr(f"substring(digest, {PREFIX + 1})").alias("asked_rest"))
    found = asked.join(kept, "prefix").where(F.col("asked_rest") == F.col("rest"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_chars", F.col("verdict")))
    return found.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict").select("url", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    Repeated rows stay repeated, a null URL has an empty host and path, and what no rule fits gets ``default`` and a null
    rule. Other columns of ``pages`` are ignored, whatever their names. An empty table gives an empty result. Pages meet
    the verdicts in an outer join on the URL. The verdicts, a row a URL, are written first: so both sides of the join have an
    exchange of their own, and a URL that many pages have is split by AQE's skew join. Null URLs don't enter it.
    """
    best = stored(url_verdicts(pages, rules, url, default).select(F.col("url").alias("of"), F.col("rule").alias("best_rule"), F.col("verdict").alias("best_verdict")))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    some = own.where(F.col("url").isNotNull())
    met = some.join(best, some.url == best["of"], "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best_rule").alias("rule"), F.coalesce("best_verdict", F.lit(default)).alias("verdict")
    )
    none = own.where(F.col("url").isNull()).select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return met.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ranked AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM ranked WHERE place = 1
"""
