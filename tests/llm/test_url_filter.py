from pyspark.sql import functions as F

from conftest_llm import LOWER, multiset
from tarn.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut].translate(LOWER), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if url is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://COM/en/", "https://a.B.Example.com/en/7?x#y", "https://example.com/en/8", "https://notexample.net/de/8", "https://x.example.net/de/81", "https://net/de",
    "http://a.org#/es/", "http://a.org/es/?q", "x://y.org/es/\nz", "http://..com/en/", "http://a.com/EN/", "http://example.com/en/7" + "/é" * 3000, "http://" + "a." * 2000 + "com/en/x",
]


def test_equals_brute_force(spark):
    rows = [(i, u, "h", "clash", "clash") for i, u in enumerate(URLS * 2)] + [(None, URLS[5], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rules_table(spark, url_filter.RULES))
    assert multiset(got, "page_id", "host", "path", "rule", "verdict") == sorted(((r[0], *brute(r[1], url_filter.RULES)) for r in rows), key=repr)


def test_no_rules_no_pages(spark):
    none = url_filter.rules_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, none).collect()[0]["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


def test_repeated_and_null_rules(spark):
    rules = url_filter.rules_table(spark, [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("com", None, "allow")])
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules).collect()[0]["verdict"] == "block"


def test_a_common_url_is_split(spark):
    """One URL on most pages: the final plan reads the join's large side in several parts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        url = F.when(F.col("id") % 6 > 0, "http://hot.example.com/en/7").when(F.col("id") % 12 > 0, F.concat(F.lit("http://x.net/de/"), F.col("id").cast("string")))
        pages = spark.range(0, 300_000, 1, 6).select(F.col("id").alias("page_id"), url.alias("url"))
        got = url_filter.filter_urls(pages, url_filter.rules_table(spark, url_filter.RULES))
        counts = {(r["rule"], r["verdict"]): r["n"] for r in got.groupBy("rule", "verdict").agg(F.count("*").alias("n")).collect()}
        assert counts == {("example.com/en/7", "allow"): 250_000, ("net/de/", "allow"): 25_000, (None, "allow"): 25_000}
        got.write.format("noop").mode("overwrite").save()
        rows = got.select("page_id", "verdict")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
