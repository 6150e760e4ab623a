"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import aggregates as op
from tarn.plans.registry import Tables, query


@query("A01_group_count", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("A02_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("A03_conditional_counts", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'R') AS n_r, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.sum("l_quantity").alias("q"))


@query("A04_totals", "SELECT 'rows' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R') FROM lineitem")
def _(t: Tables):
    return op.totals(t.lineitem, rows=F.count("*"), orders=F.count_distinct("l_orderkey"), returned=F.count_if(F.col("l_returnflag") == "R"))


@query("A05_size_distribution", "WITH s AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT count(*) FILTER (k = 1) AS singletons, max(k) AS largest, round(sum(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / sum(k), 6) AS expanded_share FROM s")
def _(t: Tables):
    return op.size_distribution(t.orders, "o_custkey")


_MODAL = "SELECT {k}, {v} AS modal, n FROM (SELECT {k}, {v}, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {v}) AS r FROM {t} WHERE {v} IS NOT NULL GROUP BY 1, 2) WHERE r = 1"


@query("A06_modal", _MODAL.format(k="o_custkey", v="o_orderpriority", t="orders"))
def _(t: Tables):
    return op.modal(t.orders, ["o_custkey"], "o_orderpriority")


@query("A07_dominant", f"WITH a AS ({_MODAL.format(k='o_custkey', v='o_orderpriority', t='orders')}), b AS ({_MODAL.format(k='o_custkey', v='o_orderstatus', t='orders')}), c AS (SELECT o_custkey, count(*) AS cells, count(DISTINCT o_orderstatus) AS n_donors FROM orders GROUP BY 1) SELECT o_custkey, a.modal AS label, a.n AS label_n, round(a.n / cells::DOUBLE, 4) AS frac, b.modal AS donor, n_donors, cells FROM c JOIN a USING (o_custkey) JOIN b USING (o_custkey)")
def _(t: Tables):
    return op.dominant(t.orders, "o_custkey", "o_orderpriority", "o_orderstatus")


@query("A08_representative", "SELECT c_nationkey, (SELECT 0) + arg_max(c_custkey, (c_acctbal, -c_custkey)) AS representative, round(sum(c_acctbal), 2) AS total, count(*) AS n_rows FROM customer GROUP BY 1")
def _(t: Tables):
    return op.representative(t.customer, "c_nationkey", "c_custkey", "c_acctbal").withColumn("total", F.round("total", 2))


@query("A09_first_per_group", "SELECT c_mktsegment, arg_min(c_name, c_custkey) AS first_name, arg_min(c_nationkey, c_custkey) AS first_nation, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.min_by("c_name", "c_custkey").alias("first_name"), F.min_by("c_nationkey", "c_custkey").alias("first_nation"), F.count("*").alias("n"))


@query("A10_joined_set", "SELECT p_size, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy("p_size").agg(op.joined_set("p_brand", ";").alias("brands"))


@query("A11_synonyms", f"WITH a AS ({_MODAL.format(k='c_nationkey', v='c_mktsegment', t='customer')}), g AS (SELECT modal, string_agg(c_nationkey::VARCHAR, '/' ORDER BY c_nationkey::VARCHAR) AS label FROM a GROUP BY 1) SELECT c_nationkey, label FROM a JOIN g USING (modal)")
def _(t: Tables):
    return op.synonyms(t.customer, "c_nationkey", ["c_mktsegment"])


@query("A12_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("A13_base_rates", "SELECT c_mktsegment, round(count(*)::DOUBLE / (SELECT count(*) FROM customer), 9) AS rate FROM customer GROUP BY 1")
def _(t: Tables):
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("c_mktsegment", F.round(F.col("n") / F.col("all"), 9).alias("rate"))


@query("A14_composition", "SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 1) AS pct FROM events GROUP BY 1")
def _(t: Tables):
    return op.rounded_share(t.events, "event_type")


@query("A15_distance_summary", "SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.01), 4) AS p1, round(avg((l_extendedprice <= 1000)::INT), 4) AS within_own, round(avg((l_extendedprice <= 5000)::INT), 4) AS within_other FROM lineitem")
def _(t: Tables):
    from tarn.operators.distances import summary

    return summary(t.lineitem, "l_extendedprice", 1000, 5000)


@query("A16_class_statistics", "WITH s AS (SELECT p_size, p_brand, count(*) AS k FROM part GROUP BY 1, 2) SELECT count(*) AS classes, count(*) FILTER (k = 1) AS singletons, sum(k * (k - 1) // 2)::BIGINT AS pairs, round(100.0::DOUBLE * (1 - count(*) FILTER (k = 1) / sum(k)::DOUBLE), 4) AS ceiling FROM s")
def _(t: Tables):
    s = t.part.groupBy("p_size", "p_brand").agg(F.count("*").alias("k"))
    return s.agg(F.count("*").alias("classes"), F.count_if(F.col("k") == 1).alias("singletons"), op.pairs_in().alias("pairs"), F.round(100.0 * (1 - F.count_if(F.col("k") == 1) / F.sum("k")), 4).alias("ceiling"))


@query("A17_pair_sharing", "SELECT level, sum(k * (k - 1) // 2)::BIGINT AS pairs FROM (SELECT 'lc' AS level, count(*) AS k FROM part GROUP BY p_size UNION ALL SELECT 'lc_va', count(*) FROM part GROUP BY p_size, p_brand UNION ALL SELECT 'lc_vb', count(*) FROM part GROUP BY p_size, p_type UNION ALL SELECT 'lc_va_vb', count(*) FROM part GROUP BY p_size, p_brand, p_type) GROUP BY 1")
def _(t: Tables):
    return op.sharing(t.part, {"lc": ["p_size"], "lc_va": ["p_size", "p_brand"], "lc_vb": ["p_size", "p_type"], "lc_va_vb": ["p_size", "p_brand", "p_type"]})


@query("A18_consensus_run", """WITH n AS (SELECT c_nationkey, count(*) AS n, min(length(c_name)) AS s FROM customer GROUP BY 1 HAVING count(*) >= 10), p AS (SELECT c_nationkey, n, i AS pos, substr(c_name, i, 1) AS c FROM customer JOIN n USING (c_nationkey), range(1, 40) r(i) WHERE i <= s),
k AS (SELECT c_nationkey, n, pos, c, count(*) AS k FROM p GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, pos ORDER BY k DESC, c) AS r FROM k), o AS (SELECT *, bool_and(k / n::DOUBLE >= 0.95) OVER (PARTITION BY c_nationkey ORDER BY pos) AS ok FROM m WHERE r = 1)
SELECT n.c_nationkey, n.n, count(pos) AS positions, coalesce(string_agg(c, '' ORDER BY pos), '') AS motif FROM n LEFT JOIN (SELECT * FROM o WHERE ok) o USING (c_nationkey) GROUP BY 1, 2""")
def _(t: Tables):
    return op.fixed_prefix(t.customer, "c_nationkey", "c_name").withColumn("positions", F.col("positions").cast("long"))


@query("A19_pivot_wide", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))


@query("A20_cell_qc", "SELECT user_id, count(*) AS total, count(DISTINCT event_type) AS detected, round(100.0::DOUBLE * count(*) FILTER (event_type = 'view') / count(*), 6) AS pct_mito FROM events GROUP BY 1")
def _(t: Tables):
    coo = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return coo.groupBy("user_id").agg(F.sum("n").alias("total"), F.count("*").alias("detected"), F.round(100.0 * F.sum(F.when(F.col("event_type") == "view", F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("pct_mito"))


@query("A21_mean_and_margin", "WITH s AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m DESC, c_mktsegment DESC) AS k, lead(m) OVER (PARTITION BY c_nationkey ORDER BY m DESC, c_mktsegment DESC) AS nxt FROM s) SELECT c_nationkey, c_mktsegment AS best, round(m - nxt, 4) AS margin FROM r WHERE k = 1")
def _(t: Tables):
    s = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    r = s.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("m", "c_mktsegment")), asc=False).alias("x"))
    return r.select("c_nationkey", F.col("x")[0]["c_mktsegment"].alias("best"), F.round(F.col("x")[0]["m"] - F.get("x", F.lit(1))["m"], 4).alias("margin"))


@query("A22_detection_fraction", "WITH s AS (SELECT c_nationkey, c_mktsegment, avg((c_acctbal > 0)::INT) AS f FROM customer GROUP BY 1, 2) SELECT c_nationkey, round(max(f), 6) AS top_fraction, arg_max(c_mktsegment, (f, c_mktsegment)) AS top FROM s GROUP BY 1")
def _(t: Tables):
    s = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("f"))
    return s.groupBy("c_nationkey").agg(F.round(F.max("f"), 6).alias("top_fraction"), F.max_by("c_mktsegment", F.struct("f", "c_mktsegment")).alias("top"))


@query("A23_duplicate_flags", "WITH d AS (SELECT lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) SELECT lang, count(*) FILTER (k > 1) AS duplicates, count(*) FILTER (k = 1) AS distinct_texts FROM d GROUP BY 1")
def _(t: Tables):
    first = t.documents.select("doc_id", "lang", F.md5("text").alias("m"))
    one = first.groupBy("m").agg(F.min_by("lang", "doc_id").alias("lang")).groupBy("lang").agg(F.count("*").alias("distinct_texts"))
    return first.groupBy("lang").agg(F.count("*").alias("n")).join(one, "lang", "left").select("lang", (F.col("n") - F.coalesce("distinct_texts", F.lit(0))).alias("duplicates"), F.coalesce("distinct_texts", F.lit(0)).alias("distinct_texts"))


@query("A24_gene_index", "WITH c AS (SELECT count(DISTINCT user_id) AS cells FROM events), g AS (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n, round(sum(v) / any_value(cells), 6) AS mean_all, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS largest FROM g, c GROUP BY 1")
def _(t: Tables):
    cells = t.events.agg(F.count_distinct("user_id").alias("cells"))
    g = t.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.percentile("v", 0.99).alias("p"), F.max("v").alias("m")).crossJoin(cells).select("event_type", "n", F.round(F.col("s") / F.col("cells"), 6).alias("mean_all"), F.round("p", 6).alias("p99"), F.round("m", 6).alias("largest"))


@query("A25_single_stratum_share", "SELECT round(avg((k = 1)::INT), 6) AS share FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1)")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("k")).agg(F.round(F.avg((F.col("k") == 1).cast("int")), 6).alias("share"))


@query("A26_size_spectrum", "SELECT k AS size, count(*) AS clusters FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query("A27_verdict_rollup", """WITH v AS (SELECT p_partkey, p_size, CASE WHEN p_size >= 38 THEN 'also' WHEN p_size >= 25 THEN 'partly' ELSE 'not' END AS verdict FROM part)
SELECT 'all' AS subset, verdict, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'ge3', verdict, count(*) FROM v WHERE p_size % 7 >= 3 GROUP BY 2 UNION ALL SELECT 'survivors', verdict, count(*) FROM v WHERE p_size % 2 = 0 GROUP BY 2""")
def _(t: Tables):
    verdict = F.when(F.col("p_size") >= 38, "also").when(F.col("p_size") >= 25, "partly").otherwise("not")
    v = t.part.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("all"), F.count_if(F.col("p_size") % 7 >= 3).alias("ge3"), F.count_if(F.col("p_size") % 2 == 0).alias("survivors"))
    return v.unpivot("verdict", ["all", "ge3", "survivors"], "subset", "n").where("n > 0")


@query("A28_channel_totals", "SELECT i - 1 AS channel, round(sum(abs(embedding[i]::DOUBLE)), 6) AS mass FROM embeddings, range(1, 9) r(i) GROUP BY 1")
def _(t: Tables):
    return t.embeddings.select(F.posexplode(F.slice("embedding", 1, 8)).alias("channel", "v")).groupBy(F.col("channel").cast("long").alias("channel")).agg(F.round(F.sum(F.abs(F.col("v").cast("double"))), 6).alias("mass"))


@query("A29_percentile_interval", "SELECT round(quantile_cont(o_totalprice, 0.025), 4) AS low, round(quantile_cont(o_totalprice, 0.975), 4) AS high FROM orders")
def _(t: Tables):
    return t.orders.agg(F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).select(F.round(F.col("p")[0], 4).alias("low"), F.round(F.col("p")[1], 4).alias("high"))


@query("A30_ordered_collect", "SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def _(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("len")))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda r: F.concat(r.role, F.lit(":"), r.len)), ",").alias("turns"))
