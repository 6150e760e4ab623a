"""Queries of joins, order, sampling and sets."""

from __future__ import annotations

from pyspark.sql import Window
import numpy as np
from pyspark.sql import functions as F

from tarn.operators import ordered
from tarn.operators import relations as op
from tarn.plans.registry import Tables, query


@query("J01_left_deduplicated", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey) ON c_custkey = o_custkey")
def _(t: Tables):
    return op.left_lookup(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey", ["o_orderkey"])


@query("J02_inner_equi", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_BEST = "SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1"


def best_contigs(t: Tables):
    return op.deduplicated(t.lineitem, ["l_orderkey", "l_returnflag"], [-F.col("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity")


@query("J03_pair_by_chain", f"WITH b AS ({_BEST}) SELECT a.l_orderkey, a.l_partkey AS \"l_partkey_A\", a.l_suppkey AS \"l_suppkey_A\", b.l_partkey AS \"l_partkey_B\", b.l_suppkey AS \"l_suppkey_B\" FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def _(t: Tables):
    return op.pair_by_part(best_contigs(t), "l_orderkey", "l_returnflag", "A", "R", ["l_partkey", "l_suppkey"])


@query("J04_left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("J05_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def _(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J06_reindex", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables):
    return op.reindex(ordered.row_numbers(t.documents.select("doc_id"), ["doc_id"]), t.labels.select("doc_id", "quality"), "doc_id")


@query("J07_suffixed_self_join", "SELECT a.c_custkey, a.c_acctbal AS bal_a, b.o_totalprice AS bal_b FROM customer a JOIN orders b ON a.c_custkey = b.o_custkey")
def _(t: Tables):
    a = t.customer.select("c_custkey", F.col("c_acctbal").alias("bal_a"))
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("bal_b"))
    return a.join(b, "c_custkey")


@query("J08_one_apart", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND length(a.c_name) = length(b.c_name) WHERE hamming(a.c_name, b.c_name) = 1")
def _(t: Tables):
    return op.one_apart(t.customer, "c_custkey", ["c_nationkey", "c_mktsegment"], "c_name")


@query("J09_all_pairs", "SELECT count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)")
def _(t: Tables):
    from tarn.operators import distances

    v = distances.pair_parts(t.embeddings, "vec_id", "embedding", ["total"], lambda a, b, once: (np.sqrt(once(distances._fast(a, b))).sum(),))
    return v.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


@query("J10_best_match", """WITH p AS (SELECT a.s_suppkey, b.n_nationkey, i, substr(a.s_name, i, 1) = substr(b.n_name, i, 1) AS eq FROM supplier a JOIN nation h ON a.s_nationkey = h.n_nationkey JOIN nation b ON h.n_regionkey = b.n_regionkey, range(1, 6) r(i) WHERE length(b.n_name) >= i),
s AS (SELECT s_suppkey, n_nationkey, avg(eq::INT) AS identity, count(*) AS shared FROM p GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT s_suppkey, n_nationkey, round(identity, 6) AS identity, shared, identity >= 0.2 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY identity DESC, n_nationkey) AS k FROM s) WHERE k = 1""")
def _(t: Tables):
    a = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("g")), "s_nationkey").select("s_suppkey", "s_name", "g")
    b = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("g"))
    p = a.join(b, "g").select("s_suppkey", "n_nationkey", "s_name", "n_name", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).where(F.length("n_name") >= F.col("i"))
    equal = F.expr("substr(s_name, i, 1) = substr(n_name, i, 1)")
    return op.best_match(p, "s_suppkey", "n_nationkey", equal, 4, 0.2).withColumn("identity", F.round("identity", 6))


_POINTS = "SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def _points(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label")


@query("J11_nearest_pair", f"WITH p AS ({_POINTS}) SELECT DISTINCT ON (a.id) a.id AS a, b.id AS b FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id ORDER BY a.id, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), b.id")
def _(t: Tables):
    from tarn.operators.distances import nearest

    p = _points(t).select("id", "label", F.array("x", "y", "z").alias("v"))
    return nearest(p, "id", "v", 1, group="label").select("a", "b")


_D = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))"
_KNN = f"SELECT * FROM (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS other_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_D}, 9), b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 5"


def _neighbours(t: Tables, k: int = 5):
    """The k nearest others of every vector, with their labels."""
    from tarn.operators.distances import nearest

    near = nearest(t.embeddings, "vec_id", "embedding", k)
    label = t.embeddings.select("vec_id", "label")
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("other")).join(label, "vec_id").join(label.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label")), "other")


@query("J12_knn_same_fraction", f"SELECT vec_id, avg((label = other_label)::INT) AS same FROM ({_KNN}) GROUP BY 1")
def _(t: Tables):
    return _neighbours(t).groupBy("vec_id").agg(F.avg((F.col("label") == F.col("other_label")).cast("int")).alias("same"))


@query("J13_knn_transfer", f"SELECT vec_id, other_label AS label, n / 5.0::DOUBLE AS confidence FROM (SELECT vec_id, other_label, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, other_label) AS r FROM ({_KNN}) GROUP BY 1, 2) WHERE r = 1")
def _(t: Tables):
    votes = _neighbours(t).groupBy("vec_id", "other_label").agg(F.count("*").alias("n"))
    return op.top_n(votes, ["vec_id"], [F.desc("n"), "other_label"], 1).select("vec_id", F.col("other_label").alias("label"), (F.col("n") / 5.0).alias("confidence"))


@query("J14_explode_map", "SELECT k.key, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS key FROM part) k GROUP BY 1")
def _(t: Tables):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("J15_contacts", f"WITH p AS ({_POINTS}) SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 0.05")
def _(t: Tables):
    p = _points(t)
    return op.near_points(p, p, 0.05).where("a < b").select("a", "b")


@query("J16_bridged_key", "SELECT count(*) AS n FROM (SELECT 'gex|' || c_custkey AS k FROM customer) a JOIN (SELECT 'gex|' || string_split('lib|' || o_custkey, '|')[-1] AS k FROM orders) b USING (k)")
def _(t: Tables):
    a = t.customer.select(F.concat(F.lit("gex|"), "c_custkey").alias("k"))
    b = t.orders.select(F.concat(F.lit("gex|"), F.element_at(F.split(F.concat(F.lit("lib|"), "o_custkey"), r"\|"), -1)).alias("k"))
    return a.join(b, "k").agg(F.count("*").alias("n"))


@query("J17_member_sets", "WITH m AS (SELECT p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members FROM part GROUP BY 1) SELECT a.members, count(*) AS n FROM m a JOIN m b USING (members) GROUP BY 1")
def _(t: Tables):
    m = op.member_sets(t.part, "p_size", "p_brand")
    return m.join(m.select("members"), "members").groupBy("members").agg(F.count("*").alias("n"))


@query("J18_multiway_alignment", "SELECT count(*) AS n, count(l.doc_id) AS with_label, count(*) = count(DISTINCT d.doc_id) AS aligned FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels.withColumn("there", F.lit(1)), "doc_id", "left")
    return joined.agg(F.count("*").alias("n"), F.count("there").alias("with_label"), (F.count("*") == F.count_distinct("doc_id")).alias("aligned"))


@query("J19_keyed_alignment", "SELECT a.l_suppkey, count(*) AS shared FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'O') a JOIN (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'F') b USING (l_suppkey, l_linenumber, l_returnflag) GROUP BY 1 HAVING count(*) >= 10")
def _(t: Tables):
    side = lambda s: t.lineitem.where(F.col("l_linestatus") == s).select("l_suppkey", "l_linenumber", "l_returnflag").distinct()
    return side("O").join(side("F"), ["l_suppkey", "l_linenumber", "l_returnflag"]).groupBy("l_suppkey").agg(F.count("*").alias("shared")).where("shared >= 10")


@query("J20_navigation", "SELECT n_nationkey AS cluster, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey) AS members FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def _(t: Tables):
    g = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_nationkey").alias("cluster")).agg(F.array_sort(F.collect_list("c_custkey")).alias("m"))
    return g.select("cluster", F.array_join(F.transform("m", lambda x: x.cast("string")), ";").alias("members"))


@query("W01_best_contig", _BEST)
def _(t: Tables):
    return best_contigs(t)


@query("W02_multi_chain", "SELECT l_orderkey, max(c) > 1 AS multi FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem) GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("c")).groupBy("l_orderkey").agg((F.max("c") > 1).alias("multi"))


@query("W03_first_occurrence", "SELECT min(c_custkey) AS c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2")
def _(t: Tables):
    return op.deduplicated(t.customer.where("c_mktsegment is not null").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"])


@query("W04_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part")
def _(t: Tables):
    return ordered.average_rank(t.part.select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


@query("W05_arc_length", "SELECT conv_id, turn, (sum(step) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS arc FROM (SELECT conv_id, turn, abs(length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), length(text)))::BIGINT AS step FROM conversations)")
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    step = F.abs(F.length("text") - F.coalesce(F.lag(F.length("text")).over(w), F.length("text")))
    return t.conversations.select("conv_id", "turn", step.alias("step")).select("conv_id", "turn", F.sum("step").over(w).alias("arc"))


@query("W06_benjamini_hochberg", "WITH p AS (SELECT p_partkey, (p_size / 51.0::DOUBLE) ** 3 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS i, count(*) OVER () AS m FROM p) SELECT p_partkey, round(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS q FROM r")
def _(t: Tables):
    p = t.part.select("p_partkey", F.pow(F.col("p_size") / 51.0, 3).alias("p"))
    return ordered.benjamini_hochberg(p, "p", "q", "p_partkey").select("p_partkey", F.round("q", 8).alias("q"))


@query("W07_percentile_in_background", "SELECT s_suppkey, 100.0::DOUBLE * (SELECT count(*) FROM customer WHERE c_acctbal <= s_acctbal) / (SELECT count(*) FROM customer) AS pct FROM supplier")
def _(t: Tables):
    return ordered.percentile_in(t.customer.select(F.col("c_acctbal").alias("d")), t.supplier.select("s_suppkey", F.col("s_acctbal").alias("d")), "d", "pct").select("s_suppkey", "pct")


@query("W08_leading_run", "SELECT conv_id, count(*) AS run FROM (SELECT conv_id, bool_and(length(text) > 40) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM conversations) WHERE ok GROUP BY 1")
def _(t: Tables):
    ok = F.min(F.length("text") > 40).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", ok.alias("ok")).where("ok").groupBy("conv_id").agg(F.count("*").alias("run"))


@query("W09_boundaries", "SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (SELECT conv_id, turn, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS b FROM conversations)")
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int").alias("b")).select("conv_id", "turn", F.sum("b").over(w).alias("run"))


@query("W10_stratum_shuffle", "WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '|7'), c_custkey) AS j FROM customer) SELECT x.c_custkey, y.c_mktsegment FROM a x JOIN a y ON x.c_nationkey = y.c_nationkey AND x.i = y.j")
def _(t: Tables):
    from tarn.operators.labels import stratum_shuffle

    return stratum_shuffle(t.customer, "c_custkey", ["c_nationkey"], "c_mktsegment", "7").select("c_custkey", "c_mktsegment")


@query("W11_dense_relabel", "WITH s AS (SELECT p_brand || p_size AS g, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1), r AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, first) - 1 AS k FROM s) SELECT g, CASE WHEN n = 1 THEN -1 ELSE k END AS cluster FROM r")
def _(t: Tables):
    from tarn.operators.clustering import relabel_by_size

    return relabel_by_size(t.part.withColumn("g", F.concat("p_brand", "p_size")), "g", "p_partkey").select("g", "cluster")


@query("W12_positional_ids", "SELECT 'clone' || lpad((row_number() OVER (ORDER BY p_name, p_partkey) - 1)::VARCHAR, 6, '0') AS clone_id, p_partkey FROM part")
def _(t: Tables):
    n = ordered.row_numbers(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"])
    return n.select(F.concat(F.lit("clone"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("clone_id"), "p_partkey")


@query("W13_shards", "SELECT shard, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS shard FROM orders) GROUP BY 1")
def _(t: Tables):
    return ordered.row_numbers(t.orders.select("o_orderkey"), ["o_orderkey"]).groupBy((F.col("ord") % 5).alias("shard")).agg(F.count("*").alias("n"))


@query("W14_factorize", "WITH f AS (SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY 1) SELECT c_mktsegment, row_number() OVER (ORDER BY first) - 1 AS code FROM f")
def _(t: Tables):
    first = t.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first"))
    return ordered.row_numbers(first, ["first"], "code").select("c_mktsegment", "code")


@query("T01_sort_key", "SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN p_size IN (33, 11, 12) THEN -p_partkey ELSE p_partkey END) AS place FROM part")
def _(t: Tables):
    key = F.when(F.col("p_size").isin(33, 11, 12), -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(key)).cast("long").alias("place"))


@query("T02_top_two_joined", "SELECT p_size, string_agg(p_brand, '/' ORDER BY k) AS markers FROM (SELECT p_size, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1, 2) WHERE k <= 2 GROUP BY 1")
def _(t: Tables):
    n = t.part.groupBy("p_size", "p_brand").agg(F.count("*").alias("n"))
    top = op.top_n(n, ["p_size"], [F.desc("n"), "p_brand"], 2).groupBy("p_size").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_brand"))).alias("x"))
    return top.select("p_size", F.array_join("x.p_brand", "/").alias("markers"))


@query("T03_top_four_counts", "SELECT c_nationkey, string_agg(c_mktsegment || ':' || n, ';' ORDER BY n DESC, c_mktsegment) AS top FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE k <= 4 GROUP BY 1")
def _(t: Tables):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    top = op.top_n(n, ["c_nationkey"], [F.desc("n"), "c_mktsegment"], 4).groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "c_mktsegment", "n"))).alias("x"))
    return top.select("c_nationkey", F.array_join(F.transform("x", lambda r: F.concat(r.c_mktsegment, F.lit(":"), r.n)), ";").alias("top"))


@query("T04_worst_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def _(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(10)


@query("T05_seeded_shuffle", "SELECT row_number() OVER (ORDER BY md5(c_custkey || '|5'), c_custkey) - 1 AS ord, c_custkey FROM customer")
def _(t: Tables):
    return ordered.row_numbers(op.shuffled(t.customer.select("c_custkey"), "c_custkey", "5"), ["u", "c_custkey"]).select("ord", "c_custkey")


@query("T06_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || '|6'), c_custkey LIMIT 50")
def _(t: Tables):
    return op.sample_sorted(t.customer.select("c_custkey"), "c_custkey", "6", 50)


_DRAW = "(('0x' || substr(md5(i || '|{s}'), 1, 8))::BIGINT % n)"


@query("T07_random_pairs", f"WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT i, {_DRAW.format(s='a')} AS a, {_DRAW.format(s='b')} AS b FROM range(2000) r(i), n) SELECT i AS draw, a, b FROM d WHERE a <> b")
def _(t: Tables):
    from tarn.operators.labels import random_pairs

    return random_pairs(t.spark, t.embeddings.count(), 2000)


@query("T08_within_class_pairs", """WITH c AS (SELECT label, count(*) AS k FROM embeddings GROUP BY 1), w AS (SELECT label, k, sum(k) OVER (ORDER BY label) - k AS lo, sum(k) OVER (ORDER BY label) AS hi FROM c), n AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j FROM embeddings),
d AS (SELECT i, ('0x' || substr(md5(i || '|c'), 1, 8))::BIGINT % n AS u, ('0x' || substr(md5(i || '|a'), 1, 8))::BIGINT AS x, ('0x' || substr(md5(i || '|b'), 1, 8))::BIGINT AS y FROM range(500) r(i), n)
SELECT d.i AS draw, p.vec_id AS a, q.vec_id AS b FROM d JOIN w ON u >= lo AND u < hi JOIN e p ON p.label = w.label AND p.j = x % k JOIN e q ON q.label = w.label AND q.j = y % k WHERE p.vec_id <> q.vec_id""")
def _(t: Tables):
    from tarn.operators.labels import within_class_pairs

    return within_class_pairs(t.embeddings, "vec_id", "label", 500)


@query("T09_medoid", "SELECT a.vec_id, round(sum(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 6) AS total FROM embeddings a, embeddings b GROUP BY 1 ORDER BY 2, 1 LIMIT 1")
def _(t: Tables):
    from tarn.operators.distances import total_squares

    return total_squares(t.embeddings, "vec_id", "embedding").select(F.col("vec_id"), F.round("total", 6).alias("total")).orderBy("total", "vec_id").limit(1)


@query("T10_trim_decile", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER () AS n FROM customer) WHERE i <= n - n // 10")
def _(t: Tables):
    n = t.customer.count()
    return ordered.row_numbers(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).where(F.col("ord") < n - n // 10).select("c_custkey")


@query("T11_nearest_to_target", "SELECT p_size, count(*) AS n FROM part GROUP BY 1 ORDER BY abs(count(*) - 8), p_size LIMIT 3")
def _(t: Tables):
    return t.part.groupBy("p_size").agg(F.count("*").alias("n")).orderBy(F.abs(F.col("n") - 8), "p_size").limit(3)


@query("T12_rule_pick", "WITH g AS (SELECT p_size, round(avg(p_retailprice), 4) AS r FROM part GROUP BY 1) SELECT min(p_size) AS pick FROM g WHERE r <= (SELECT min(r) FROM g) + 20")
def _(t: Tables):
    g = t.part.groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("r"))
    return g.crossJoin(F.broadcast(g.agg(F.min("r").alias("least")))).where("r <= least + 20").agg(F.min("p_size").alias("pick"))


@query("U01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("U02_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("U03_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).exceptAll(t.customer.where("c_acctbal > 0").select("c_custkey")).distinct().join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k", "left_anti")


_SETS = "WITH a AS (SELECT DISTINCT doc_id AS k FROM documents), b AS (SELECT DISTINCT doc_id AS k FROM labels), j AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)"


@query("U04_symmetric_difference", f"{_SETS} SELECT count(*) FILTER (r IS NULL) + count(*) FILTER (l IS NULL) AS n FROM j")
def _(t: Tables):
    return op.set_flags(t.documents, t.labels, "doc_id").select((F.col("only_left") + F.col("only_right")).alias("n"))


@query("U05_set_checks", f"{_SETS} SELECT count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL OR l IS NULL) = 0 AS same, count(*) FILTER (r IS NULL) = 0 AS subset FROM j")
def _(t: Tables):
    return op.set_flags(t.documents, t.labels, "doc_id")


@query("U06_union_all", "SELECT 'c' AS arm, c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier")
def _(t: Tables):
    arm = lambda df, a, k, v: df.select(F.lit(a).alias("arm"), F.col(k).alias("k"), F.col(v).alias("v"))
    return arm(t.customer, "c", "c_nationkey", "c_acctbal").unionByName(arm(t.supplier, "s", "s_nationkey", "s_acctbal"))


@query("N66_mutual_neighbour_groups")
def _(t: Tables):
    """Connected components of mutual nearest neighbours, in the place of community detection; it isn't the same partition."""
    from tarn.operators.clustering import connected

    near = _neighbours(t).select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    mutual = near.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")
    return connected(mutual).groupBy("root").agg(F.count("*").alias("members"))
