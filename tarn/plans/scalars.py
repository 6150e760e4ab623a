"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import numeric, sequence
from tarn.operators import labels as lab
from tarn.plans.registry import Tables, query

_CODON = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sequence.CODE.items()) + ") c(codon, aa)"


@query("X01_translate", f"WITH s AS (SELECT item_id, upper(regexp_replace(regexp_replace(text, '[^A-Za-z.\\-]', 'N', 'g'), '[.\\-]', '', 'g')) AS s FROM benchmark), k AS (SELECT item_id, i, substr(s, i, 3) AS codon FROM s, range(1, 600, 3) r(i) WHERE i <= length(s) - 2) SELECT item_id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS aa FROM k LEFT JOIN {_CODON} USING (codon) GROUP BY 1")
def _(t: Tables):
    return t.benchmark.select("item_id", sequence.translate(F.regexp_replace("text", r"[^A-Za-z.\-]", "N")).alias("aa"))


@query("X02_assemble", "SELECT p_partkey, CASE WHEN NOT regexp_matches(upper(p_name || p_brand), '^[ACGTN]*$') THEN p_name || p_brand ELSE p_type END AS seq FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", sequence.assemble([F.col("p_name"), F.col("p_brand")], F.col("p_type")).alias("seq"))


@query("X03_splice", "SELECT c_custkey, substr(c_name, 1, 9) || c_mktsegment || substr(n_name, 3) AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", sequence.splice(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"), 9, 3).alias("seq"))


@query("X04_gene_stem", "SELECT p_partkey, regexp_replace(split_part(p_brand || 'D*01', '*', 1), 'D$', '') AS stem FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", sequence.stem(F.concat("p_brand", F.lit("D*01"))).alias("stem"))


@query("X05_lane", "SELECT o_orderkey, try_cast(string_split(o_orderpriority || '-' || (o_orderkey % 4), '-')[-1] AS INT) AS lane FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", sequence.lane(F.concat_ws("-", "o_orderpriority", F.col("o_orderkey") % 4)).alias("lane"))


@query("X06_nth_field", "SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS field FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", sequence.nth_field(F.col("o_orderpriority"), "-", 2).alias("field"))


@query("X07_hamming", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, hamming(a.s_name, b.s_name) AS h FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _(t: Tables):
    from tarn.operators.relations import hamming_pairs

    return hamming_pairs(t.supplier, "s_suppkey", "s_nationkey", "s_name")


@query("X08_positional_identity", """WITH x AS (SELECT p_partkey % 20 AS k, p_size AS pos, min(p_brand) AS c FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), y AS (SELECT (p_partkey - 1) % 20 AS k, p_size AS pos, min(p_brand) AS c FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
SELECT k, round(avg(coalesce(x.c = y.c, false)::INT), 6) AS identity FROM x FULL JOIN y USING (k, pos) GROUP BY 1""")
def _(t: Tables):
    side = lambda odd, c: t.part.where(F.col("p_partkey") % 2 == odd).groupBy(((F.col("p_partkey") - odd) % 20).alias("k"), F.col("p_size").alias("pos")).agg(F.min("p_brand").alias(c))
    return side(0, "x").join(side(1, "y"), ["k", "pos"], "full").groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("x") == F.col("y"), F.lit(False)).cast("int")), 6).alias("identity"))


@query("X09_alignment_distance")
def _(t: Tables):
    s = t.nation.select("n_nationkey", F.upper("n_name").alias("s"))
    pairs = s.select(F.col("n_nationkey").alias("a"), F.col("s").alias("x")).join(s.select(F.col("n_nationkey").alias("b"), F.col("s").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(sequence.alignment_distance("x", "y"), 6).alias("d"))


@query("X10_substitution_lookup", "SELECT p_partkey, coalesce(CASE substr(p_brand, -1) WHEN '1' THEN 4 WHEN '2' THEN 3 END, 0) AS cost FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(sequence.literal_map({"1": 4, "2": 3}), F.substring("p_brand", -1, 1)), F.lit(0)).alias("cost"))


@query("X11_region", "SELECT p_partkey, CASE WHEN p_size + 70 BETWEEN 105 AND 117 THEN 'CDR3' WHEN p_size + 70 BETWEEN 81 AND 86 THEN 'HV4' ELSE 'FW' END AS region FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", sequence.region(F.col("p_size") + 70).alias("region"))


_RESIDUES = "['ALA', 'TRP', 'XYZ', 'lys', 'GLY']"


@query("X12_residue_code", f"SELECT vec_id, ({_RESIDUES})[vec_id % 5 + 1] AS res, (['A', 'W', NULL, NULL, 'G'])[vec_id % 5 + 1] AS code FROM embeddings")
def _(t: Tables):
    """One-letter codes of residue names, known and unknown ones, a name a vector."""
    names = F.array(*[F.lit(n) for n in ("ALA", "TRP", "XYZ", "lys", "GLY")])
    named = t.embeddings.select("vec_id", F.element_at(names, (F.col("vec_id") % 5 + 1).cast("int")).alias("res"))
    return named.withColumn("code", F.try_element_at(sequence.literal_map(sequence.ONE_LETTER), F.col("res")))


@query("X13_short_tag", "SELECT c_custkey, substr(sha1(c_name || '|' || c_mktsegment), 1, 10) AS tag FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", sequence.short_tag(F.col("c_name"), F.col("c_mktsegment")).alias("tag"))


@query("X14_version_extraction", "SELECT p_partkey, regexp_extract('tool v' || p_size || '.' || (p_partkey % 10) || ' x', 'v([0-9]+[.][0-9]+)', 1) AS version FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.regexp_extract(F.concat(F.lit("tool v"), "p_size", F.lit("."), F.col("p_partkey") % 10, F.lit(" x")), r"v([0-9]+[.][0-9]+)", 1).alias("version"))


@query("X15_key_concatenation", "SELECT p_partkey, (length(p_name) - length(p_type))::INT AS length_class, concat_ws('|', p_name, p_brand, p_type) AS key FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", (F.length("p_name") - F.length("p_type")).alias("length_class"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("key"))


@query("X16_origin", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL WHEN 5 <= p_size % 9 THEN 'V' WHEN 5 > 12 - p_size % 4 THEN 'J' ELSE 'junction' END AS origin FROM part")
def _(t: Tables):
    n_v = F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 9)
    return t.part.select("p_partkey", sequence.origin(F.lit(5), n_v, F.col("p_size") % 4, F.lit(12)).alias("origin"))


@query("X17_centred_log_ratio", "WITH m AS (SELECT event_type, avg(ln(1 + value)) AS m FROM events WHERE value > 0 GROUP BY 1) SELECT event_id, round(ln(1 + value) - m, 6) AS clr FROM events JOIN m USING (event_type)")
def _(t: Tables):
    return numeric.centred_log_ratio(t.events.select("event_id", "event_type", "value"), "event_type", "value", "clr").select("event_id", F.round("clr", 6).alias("clr"))


@query("X18_normalised", "WITH s AS (SELECT user_id, sum(value) AS s FROM events GROUP BY 1) SELECT event_id, round(ln(1 + 10000.0::DOUBLE * value / s), 6) AS x FROM events JOIN s USING (user_id)")
def _(t: Tables):
    return numeric.normalised(t.events.select("event_id", "user_id", "value"), "user_id", "value", "x").select("event_id", F.round("x", 6).alias("x"))


@query("X19_z_score", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey)) / stddev_pop(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS z FROM customer")
def _(t: Tables):
    return numeric.z_scored(t.customer, "c_acctbal", ["c_nationkey"], "z").select("c_custkey", F.round("z", 6).alias("z"))


@query("X20_rms_distance", "SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) / 64), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    from tarn.operators.distances import rms

    b = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(rms("x", "y", 64), 6).alias("d"))


@query("X21_combined_distance", "SELECT c_custkey, round(sqrt(c_nationkey ** 2 + (0.5 * c_custkey) ** 2 + (0.3 * 2 * length(c_name)) ** 2), 6) AS d FROM customer")
def _(t: Tables):
    from tarn.operators.distances import combined

    return t.customer.select("c_custkey", F.round(combined(F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double"), F.length("c_name").cast("double"), 0.5, 0.3, 2.0), 6).alias("d"))


@query("X22_unit_vector", "WITH v AS (SELECT vec_id, embedding[1:3] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE ** 2))) AS n FROM v) SELECT vec_id, list_transform(v, lambda x: CASE WHEN n < 0.2 THEN 0.0::DOUBLE ELSE round(x::DOUBLE / n, 6) END) AS u FROM n")
def _(t: Tables):
    u = t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("v")).select("vec_id", numeric.unit("v", 0.2).alias("u"))
    return u.select("vec_id", F.transform("u", lambda x: F.round(x, 6)).alias("u"))


@query("X23_index_resample", "SELECT vec_id, list_transform(range(0, 10), lambda i: round(embedding[least(floor(i * 63 / 9.0::DOUBLE)::INT, 62) + 1]::DOUBLE + (i * 63 / 9.0::DOUBLE - least(floor(i * 63 / 9.0::DOUBLE)::INT, 62)) * (embedding[least(floor(i * 63 / 9.0::DOUBLE)::INT, 62) + 2]::DOUBLE - embedding[least(floor(i * 63 / 9.0::DOUBLE)::INT, 62) + 1]::DOUBLE), 6)) AS v FROM embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", numeric.resample("embedding", 10).alias("v")).select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("X25_rotation_angle", "SELECT p_partkey, round(degrees(acos(greatest(-1, least(1, (p_size / 10.0::DOUBLE - 1) / 2)))), 6) AS angle FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(numeric.rotation_angle(F.col("p_size") / 10.0), 6).alias("angle"))


@query("X26_quantise", "SELECT event_id, greatest(1, least(255, round_even(255 * value / 100.0::DOUBLE, 0)))::INT AS q FROM events")
def _(t: Tables):
    return t.events.select("event_id", numeric.quantised(F.col("value"), F.lit(100.0)).alias("q"))


@query("X27_rounded_threshold", "WITH c AS (SELECT round(quantile_cont(o_totalprice, 0.01), 4) AS cut FROM orders) SELECT cut, count(*) FILTER (o_totalprice <= cut) AS n FROM orders, c GROUP BY 1")
def _(t: Tables):
    from tarn.operators.distances import cut_at

    cut = cut_at(t.orders, "o_totalprice")
    return t.orders.agg(F.lit(cut).alias("cut"), F.count_if(F.col("o_totalprice") <= cut).alias("n"))


@query("X28_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("X29_label_strings", "SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN 'bound' ELSE 'unbound' END, ((year(o_orderdate) // 2) * 2)::VARCHAR) AS label FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", "bound").otherwise("unbound"), (F.floor(F.year("o_orderdate") / 2) * 2).cast("string")).alias("label"))


@query("X30_binomial_tail", """WITH v AS (SELECT p_partkey, p_size::BIGINT AS n, (p_partkey % (p_size + 1))::BIGINT AS k FROM part)
SELECT p_partkey, round(coalesce((SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.3::DOUBLE) + (n - i) * ln(0.7::DOUBLE))) FROM range(0, 60) r(i) WHERE i >= k AND i <= n), 0), 8) AS p FROM v""")
def _(t: Tables):
    n, k = F.col("p_size").cast("long"), (F.col("p_partkey") % (F.col("p_size") + 1)).cast("long")
    return t.part.select("p_partkey", n.alias("n"), k.alias("k")).select("p_partkey", F.round(lab.binomial_tail(F.col("n"), F.col("k"), F.lit(0.3)), 8).alias("p"))


@query("X31_choose_two", "SELECT p_partkey, (p_size * (p_size - 1) // 2)::BIGINT AS c FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.expr("bigint(p_size) * (p_size - 1) div 2").alias("c"))
