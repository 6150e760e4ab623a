"""Queries of sources, sinks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import numeric
from tarn.operators import filters as op
from tarn.plans.registry import Tables, query
from tarn.sources.storage import materialize
from tarn.sources import files


@query("F01_text_boolean", "SELECT doc_id, quality, toxic FROM labels WHERE lower(trim(quality::VARCHAR)) IN ('true','1','t','yes')")
def _(t: Tables):
    return op.where_true_if_there(t.labels, "quality", "is_cell").select("doc_id", "quality", "toxic")


@query("F02_number_or_zero", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE coalesce(try_cast(l_quantity::VARCHAR AS DOUBLE), 0) >= 25 GROUP BY 1")
def _(t: Tables):
    return t.lineitem.where(op.number_or_zero("l_quantity") >= 25).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("F03_resolve_columns", "SELECT c_custkey AS id, c_mktsegment AS grp FROM customer")
def _(t: Tables):
    return op.resolve(t.customer, id=("clone", "C_CUSTKEY"), grp=("segment", "C_MktSegment", "c_name"))


@query("F04_chain_label", """SELECT p_partkey, CASE WHEN starts_with(upper('TR' || substr(p_name, 1, 1)), 'TRA') THEN 'A' WHEN starts_with(upper('TR' || substr(p_name, 1, 1)), 'TRB') THEN 'B'
 WHEN starts_with(upper('TR' || substr(p_brand, length(p_brand), 1)), 'TRA') THEN 'A' ELSE NULL END AS chain FROM part""")
def _(t: Tables):
    last = F.substring("p_brand", -1, 1)
    return t.part.select("p_partkey", op.chain_of(F.concat(F.lit("TR"), F.substring("p_name", 1, 1)), F.concat(F.lit("TR"), last)).alias("chain"))


@query("F05_all_segments_present", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").dropna(how="any", subset=["text", "quality", "toxic"]).agg(F.count("*").alias("n"))


@query("F06_sequence_validity", """SELECT item_id, length(s) AS len FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark)
 WHERE length(s) BETWEEN 100 AND 145 AND NOT regexp_matches(s, '[X*]') AND regexp_matches('C' || s || 'F', '^C.*[FWC]$')""")
def _(t: Tables):
    s = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return t.benchmark.select("item_id", s.alias("s")).where(op.valid_sequence(F.col("s"), F.concat(F.lit("C"), "s", F.lit("F")))).select("item_id", F.length("s").cast("long").alias("len"))


@query("F07_qc_thresholds", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_quantity < 45 AND l_discount >= 0.02 AND l_discount <= 0.08 GROUP BY 1")
def _(t: Tables):
    return t.lineitem.where(op.between_strict("l_quantity", 5, 45) & op.between_strict("l_discount", 0.02, 0.08, closed=True)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("F08_subset_flags", """SELECT o_orderkey, coalesce(bool_or(l_suppkey % 7 = 1 AND l_returnflag = 'A'), false) AS in_subset FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t: Tables):
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_suppkey") % 7 == 1) & (F.col("l_returnflag") == "A")).alias("f"))
    return t.orders.select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", F.coalesce("f", F.lit(False)).alias("in_subset"))


@query("F09_attrition", """WITH s AS (SELECT l_orderkey, true AS p0, l_quantity >= 10 AS p1, l_quantity >= 10 AND l_returnflag IN ('A','R') AS p2, l_quantity >= 10 AND l_returnflag IN ('A','R') AND l_discount > 0.03 AS p3 FROM lineitem)
SELECT 0 AS step, 'all' AS name, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_entities FROM s
UNION ALL SELECT 1, 'quantity', count(*), count(DISTINCT l_orderkey) FROM s WHERE p1
UNION ALL SELECT 2, 'flag', count(*), count(DISTINCT l_orderkey) FROM s WHERE p2
UNION ALL SELECT 3, 'discount', count(*), count(DISTINCT l_orderkey) FROM s WHERE p3""")
def _(t: Tables):
    return op.attrition(t.lineitem, [("quantity", F.col("l_quantity") >= 10), ("flag", F.col("l_returnflag").isin("A", "R")), ("discount", F.col("l_discount") > 0.03)], "l_orderkey")


@query("F10_prepared_variants", """WITH b AS (SELECT * FROM lineitem WHERE l_quantity >= 10),
v AS (SELECT 'main' AS variant, * FROM b UNION ALL SELECT 'sens', * FROM lineitem UNION ALL SELECT 'primary', * FROM b WHERE l_discount >= 0.05),
k AS (SELECT variant, l_orderkey FROM v WHERE l_returnflag IN ('A','R') GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 2)
SELECT variant, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_cells FROM v SEMI JOIN k USING (variant, l_orderkey) GROUP BY 1""")
def _(t: Tables):
    base = t.lineitem.where("l_quantity >= 10")
    out = None
    for name, df in (("main", base), ("sens", t.lineitem), ("primary", base.where("l_discount >= 0.05"))):
        one = op.having_all(df, "l_orderkey", "l_returnflag", ["A", "R"]).agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_cells")).select(F.lit(name).alias("variant"), "n_rows", "n_cells")
        out = one if out is None else out.unionByName(one)
    return out.where("n_rows > 0")


@query("F11_position_sets", "SELECT CASE WHEN p_size BETWEEN 27 AND 38 THEN 1 WHEN p_size BETWEEN 5 AND 12 THEN 2 ELSE 3 END AS loop_no, count(*) AS n FROM part WHERE p_size BETWEEN 27 AND 38 OR p_size BETWEEN 5 AND 12 OR p_size BETWEEN 45 AND 50 GROUP BY 1")
def _(t: Tables):
    n = F.col("p_size")
    loops = F.when(n.between(27, 38), 1).when(n.between(5, 12), 2).when(n.between(45, 50), 3)
    return t.part.withColumn("loop_no", loops).where("loop_no is not null").groupBy("loop_no").agg(F.count("*").alias("n"))


@query("F12_gates", """SELECT 'size' AS gate, count(*) FILTER (NOT p_size >= 10) AS n FROM part UNION ALL SELECT 'price', count(*) FILTER (NOT p_retailprice < 1500) FROM part
UNION ALL SELECT 'brand', count(*) FILTER (NOT ends_with(p_brand, '3')) FROM part UNION ALL SELECT 'accepted', count(*) FILTER (p_size >= 10 AND p_retailprice < 1500 AND ends_with(p_brand, '3')) FROM part""")
def _(t: Tables):
    return op.gates(t.part, {"size": F.col("p_size") >= 10, "price": F.col("p_retailprice") < 1500, "brand": F.col("p_brand").endswith("3")})


@query("F13_relabel", "SELECT o_orderkey, o_orderpriority AS o_orderpriority_before, CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '2-HIGH' THEN 'hot' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(t: Tables):
    lookup = t.spark.createDataFrame([("1-URGENT", "hot"), ("2-HIGH", "hot")], "old string, new string")
    return op.relabel(t.orders, "o_orderpriority", lookup, "old", "new").select("o_orderkey", "o_orderpriority", "o_orderpriority_before")


@query("F14_guarded_naming", """WITH s AS (SELECT user_id, event_type, avg(value) - 50 AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type DESC) AS k, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, event_type DESC) AS nxt FROM s),
a AS (SELECT user_id, avg((event_type = 'click')::INT) AS ambient FROM events GROUP BY 1)
SELECT user_id, CASE WHEN ambient >= 0.5 THEN 'ambient' WHEN score > 0 AND (nxt IS NULL OR score - nxt > 0.02) THEN event_type ELSE 'unassigned' END AS name FROM r JOIN a USING (user_id) WHERE k = 1""")
def _(t: Tables):
    scored = t.events.groupBy("user_id", "event_type").agg((F.avg("value") - 50).alias("score"), F.count("*").alias("n"))
    each = scored.groupBy("user_id").agg(F.collect_list(F.struct("score", F.col("event_type").alias("name"))).alias("scores"), (F.sum(F.when(F.col("event_type") == "click", F.col("n")).otherwise(0)) / F.sum("n")).alias("ambient"))
    return each.select("user_id", op.guarded_name(F.col("scores"), F.col("ambient")).alias("name"))


@query("F15_outside_box", "SELECT round(avg((NOT (embedding[1] >= -0.2 AND embedding[1] < 0.2 AND embedding[2] >= -0.2 AND embedding[2] < 0.2 AND embedding[3] >= -0.2 AND embedding[3] < 0.2))::INT), 6) AS outside FROM embeddings")
def _(t: Tables):
    inside = op.in_box([F.col("embedding")[i].cast("double") for i in range(3)], [-0.2] * 3, [0.2] * 3)
    return t.embeddings.agg(F.round(F.avg((~inside).cast("int")), 6).alias("outside"))


@query("F16_name_exclusion", "SELECT p_partkey FROM part WHERE NOT regexp_matches(upper(p_name), '^(A|M|RP)')")
def _(t: Tables):
    return t.part.where(~F.upper("p_name").rlike("^(A|M|RP)")).select("p_partkey")


@query("F17_cluster_filter", """SELECT c_nationkey AS cluster, count(*) AS members FROM customer GROUP BY 1 HAVING count(*) >= 3 AND bool_or(contains(c_name, '7'))""")
def _(t: Tables):
    g = t.customer.groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("members"), F.max(F.col("c_name").contains("7")).alias("hit"))
    return g.where("members >= 3 and hit").select("cluster", "members")


@query("F18_join_coverage", "SELECT 'labels' AS step, round(avg((l.doc_id IS NOT NULL)::INT), 6) AS value, avg((l.doc_id IS NOT NULL)::INT) >= 0.01 AS passed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(t: Tables):
    there = t.documents.join(t.labels.select("doc_id").distinct().withColumn("there", F.lit(1)), "doc_id", "left")
    share = F.avg(F.col("there").isNotNull().cast("int"))
    return there.agg(F.lit("labels").alias("step"), F.round(share, 6).alias("value"), (share >= 0.01).alias("passed"))


@query("S01_column_subset_scan", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 5")
def _(t: Tables):
    return files.round_trip_csv(t.customer, "c_custkey long, c_mktsegment string, c_nationkey int").where("c_nationkey < 5").select("c_custkey", "c_mktsegment")


@query("S02_scan_invariants", "SELECT bool_and(l_returnflag IN ('A','N','R')) AS chains_ok, bool_and(l_quantity > 0) AS flags_ok, count(*) AS n FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.bool_and(F.col("l_returnflag").isin("A", "N", "R")).alias("chains_ok"), F.bool_and(F.col("l_quantity") > 0).alias("flags_ok"), F.count("*").alias("n"))


@query("S03_coo_matrix", "SELECT user_id AS cell, event_type AS feature, CASE WHEN event_type < 'm' THEN 'Antibody Capture' ELSE 'Gene Expression' END AS feature_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables):
    """Counts written as a Matrix Market folder (matrix, features, barcodes) and read from it."""
    from tarn.sources import matrix

    kind = F.when(F.col("event_type") < "m", "Antibody Capture").otherwise("Gene Expression")
    coo = t.events.groupBy(F.col("user_id").cast("string").alias("cell"), F.col("event_type").alias("feature"), kind.alias("feature_type")).agg(F.count("*").alias("n"))
    return matrix.read(t.spark, matrix.write(coo)).select(F.col("cell").cast("long").alias("cell"), "feature", "feature_type", "n")


@query("S04_multi_source_load", "SELECT 'gex|' || c_custkey AS cell, 'c' AS lib, c_acctbal AS x, NULL::VARCHAR AS y FROM customer UNION ALL SELECT 'sup|' || s_suppkey, 's', NULL, s_name FROM supplier")
def _(t: Tables):
    return files.concat_sources({"gex": ("c", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))), "sup": ("s", t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("y")))})


@query("S05_deposit_walk")
def _(t: Tables):
    return files.walk(t.spark, t.folder, "*.parquet").select("kind", F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name")).distinct()


@query(
    "S05_archive_members",
    "SELECT lang || '-' || (doc_id // 20) || '.tar' AS path, lpad(doc_id::VARCHAR, 9, '0') || '.txt.gz' AS member, octet_length(encode(coalesce(text, ''))) AS length, CASE WHEN regexp_matches(split_part(coalesce(text, ''), chr(10), 1), '[,;\t]') THEN 'table' ELSE 'text' END AS kind FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '^[\\[{]')",
)
def _(t: Tables):
    """The members of archives of twenty texts each: names, unpacked lengths, and kinds by content."""
    texts = t.documents.where(~F.coalesce("text", F.lit("")).rlike(r"^[\[{]"))
    deposit = files.archived(texts, F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit(".tar")), F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt.gz")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return files.members(deposit).select("path", "member", "length", "kind")


_SNIFFED = "SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line, length(line) - length(replace(line, ',', '')) AS c, length(line) - length(replace(line, chr(9), '')) AS t, length(line) - length(replace(line, ';', '')) AS s FROM documents"


@query("S06_header_sniff", f"SELECT doc_id, CASE WHEN c >= t AND c >= s THEN ',' WHEN t >= s THEN chr(9) ELSE ';' END AS separator, greatest(c, t, s) + 1 AS n_columns FROM ({_SNIFFED})")
def _(t: Tables):
    """The separator of every text's first line, and the columns that it makes."""
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    lines = t.documents.select("doc_id", line.alias("line")).withColumn("separator", files.separator(F.col("line")))
    return lines.select("doc_id", "separator", (F.length("line") - F.length(F.replace("line", "separator")) + 1).cast("long").alias("n_columns"))


@query("S07_best_source", "SELECT p_brand, arg_max(p_partkey, 4 * (p_size > 25)::INT + 2 * ends_with(p_type, 'STEEL')::INT + p_size / 100.0 - p_partkey * 1e-9) AS source FROM part GROUP BY 1")
def _(t: Tables):
    score = 4 * (F.col("p_size") > 25).cast("int") + 2 * F.col("p_type").endswith("STEEL").cast("int") + F.col("p_size") / 100.0
    return files.best_source(t.part, "p_brand", "p_partkey", score)


@query("S12_chunked_scan", "SELECT (i // 200)::BIGINT AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1")
def _(t: Tables):
    """200 items a chunk in the order of their keys."""
    from tarn.operators.ordered import row_numbers

    numbered = row_numbers(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "i")
    return numbered.groupBy(F.floor(F.col("i") / 200).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S13_bundle_order_check", "SELECT count(*) AS n, count(*) FILTER (label <> i % 10) AS out_of_order FROM (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)")
def _(t: Tables):
    """A bundle's label array, by place, against what the canonical order asks for at that place."""
    from tarn.operators.ordered import row_numbers
    from tarn.sources.storage import materialize

    order = row_numbers(t.embeddings.select("vec_id"), ["vec_id"], "i")
    bundle = materialize(t.embeddings.select(F.col("vec_id").alias("of"), "label"), "bundle")
    return order.join(bundle, F.col("vec_id") == F.col("of"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("i") % 10).alias("out_of_order"))


@query("S14_block_scan", "SELECT vec_id, list_transform(embedding[17:32], lambda x: round(x::DOUBLE, 6)) AS block FROM embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", F.transform(F.slice("embedding", 17, 16), lambda x: numeric.rounded(x, 6)).alias("block"))


@query("S16_verified_files", "SELECT * FROM (VALUES ('nation', 'kept'), ('region', 'kept'), ('absent', 'missing'), ('supplier', 'other digest')) v(name, state)")
def _(t: Tables):
    """Every named file against the digest that is expected of it; executors read the files, wherever they are."""
    listed = t.spark.read.format("binaryFile").option("pathGlobFilter", "{nation,region}.parquet").load(t.folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))
    expected = {r["name"]: r["digest"] for r in listed.collect()} | {"absent.parquet": "0" * 64, "supplier.parquet": "0" * 64}
    return files.verified(t.spark, t.folder, expected).select(F.regexp_extract("name", "^(.*)[.]parquet$", 1).alias("name"), "state")


@query("S18_reference_pick", "SELECT DISTINCT ON (p_brand) p_brand, p_name AS allele FROM part ORDER BY p_brand, (p_size = 1) DESC, p_name")
def _(t: Tables):
    return files.pick(t.part, "p_brand", F.col("p_size") == 1, "p_name").withColumnRenamed("picked", "allele")


_LOGICAL = "SELECT page_id, regexp_extract(coalesce(url, ''), '://[^/]*/([^?#]*)', 1) AS logical FROM pages"


@query("S20_path_resolution", f"SELECT page_id, logical, CASE WHEN logical = 'en/7' OR starts_with(logical, 'en/7/') THEN '/deep' || substr(logical, 5) WHEN logical = 'en' OR starts_with(logical, 'en/') THEN '/top' || substr(logical, 3) WHEN logical = 'de' OR starts_with(logical, 'de/') THEN '/de2' || substr(logical, 3) ELSE logical END AS physical FROM ({_LOGICAL})")
def _(t: Tables):
    logical = F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/]*/([^?#]*)", 1)
    return t.pages.select("page_id", logical.alias("logical")).select("page_id", "logical", files.resolved(F.col("logical"), {"en": "/top", "en/7": "/deep", "de": "/de2"}).alias("physical"))


@query("S21_error_rows", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 100.0 / (p_size % 10) END AS value, p_size % 10 = 0 AS failed FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.expr("try_divide(100.0D, p_size % 10)").alias("value"), F.expr("try_divide(1, p_size % 10) is null").alias("failed"))


@query("K01_csv_sink", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return files.round_trip_csv(t.nation, "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name")


@query("K02_json_summary", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def _(t: Tables):
    return files.round_trip_json(t.orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "n long, total double")


@query("K03_array_bundle", "SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings")
def _(t: Tables):
    from tarn.sources.storage import materialize

    return materialize(t.embeddings, "bundle").select("vec_id", "label", F.transform("embedding", lambda x: numeric.rounded(x, 6)).alias("embedding"))


@query(
    "K06_chunks",
    """WITH RECURSIVE s AS (SELECT conv_id, sum(length(text)) AS len, row_number() OVER (ORDER BY conv_id) AS i FROM conversations GROUP BY 1),
    w AS (SELECT i, conv_id, len, len AS sofar, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.i, s.conv_id, s.len, CASE WHEN w.sofar > 4000 THEN s.len ELSE w.sofar + s.len END, CASE WHEN w.sofar > 4000 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN s ON s.i = w.i + 1)
    SELECT chunk::BIGINT AS chunk, count(*) AS items, sum(len)::BIGINT AS chars FROM w GROUP BY 1""",
)
def _(t: Tables):
    """A new chunk begins after the one that exceeds 4,000 characters."""
    sizes = t.conversations.groupBy("conv_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("len"))
    return files.chunks(sizes, "conv_id", "len", 4000).groupBy("chunk").agg(F.count("*").alias("items"), F.sum("len").alias("chars"))


@query(
    "K06_chunk_payloads",
    """WITH RECURSIVE s AS (SELECT conv_id, sum(length(text)) AS len, row_number() OVER (ORDER BY conv_id) AS i, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
    w AS (SELECT i, conv_id, len, len AS sofar, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.i, s.conv_id, s.len, CASE WHEN w.sofar > 4000 THEN s.len ELSE w.sofar + s.len END, CASE WHEN w.sofar > 4000 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN s ON s.i = w.i + 1)
    SELECT chunk::BIGINT AS chunk, md5(string_agg(to_base64(encode(coalesce(body, ''))), ',' ORDER BY w.conv_id)) AS payload_md5 FROM w JOIN s USING (i) GROUP BY 1""",
)
def _(t: Tables):
    """Each chunk's conversations as base64, in their order."""
    turns = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text"))))
    whole = t.conversations.groupBy("conv_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("len"), F.array_join(turns["text"], "\n").alias("body"))
    got = files.payloads(files.chunks(materialize(whole, "conversations"), "conv_id", "len", 4000), "chunk", "conv_id", F.encode("body", "UTF-8"))
    return got.select("chunk", F.md5("payload").alias("payload_md5"))


@query("K07_quantised_features", """WITH e AS (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, max(v) AS vmax FROM e GROUP BY 1)
SELECT event_type AS feature, user_id, greatest(1, least(255, round_even(255 * v / vmax, 0)))::INT AS code FROM e JOIN m USING (event_type)""")
def _(t: Tables):
    """One file a feature, of (cell, code) rows: a feature's cells are never one row."""
    e = t.events.groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    m = e.groupBy(F.col("event_type").alias("feature")).agg(F.max("v").alias("vmax"))
    code = F.greatest(F.lit(1), F.least(F.lit(255), F.bround(255 * F.col("v") / F.col("vmax")).cast("int")))
    return files.by_feature(e.join(m, F.col("event_type") == F.col("feature")).select("feature", "user_id", code.alias("code")), "feature", "user_id")


@query("K10_json_rows", """SELECT c_custkey, '{"a":' || c_custkey || ',"b":null}' AS json FROM customer""")
def _(t: Tables):
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("a"), F.nanvl(F.lit(float("nan")), F.lit(None).cast("double")).alias("b")), {"ignoreNullFields": "false"}).alias("json"))


@query("K11_keep_last", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) > 0 AS seen FROM events GROUP BY 1")
def _(t: Tables):
    return files.keep_last(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"), (F.col("event_id") >= 0).alias("seen"))


@query("K12_replace_partitions", "SELECT o_orderstatus, sum(n)::BIGINT AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT 'F', 7) GROUP BY 1")
def _(t: Tables):
    old = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return files.replace_partitions(old, t.spark.createDataFrame([("F", 7)], "o_orderstatus string, n long"), "o_orderstatus")


@query("K04_pair_table", "SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def _(t: Tables):
    from tarn.operators.distances import all_pairs

    return all_pairs(t.embeddings, "vec_id", "embedding").select("a", "b", F.round("d", 6).alias("d"))


@query(
    "S19_merged_config",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 2.0 END AS min_umis, 1.0::DOUBLE AS percent, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 100.0::DOUBLE ELSE 0.15 END AS most_q, c_mktsegment AS separator,
    CASE WHEN c_custkey % 5 = 0 THEN 'cells.umis' WHEN c_custkey % 7 = 0 THEN 'other' ELSE '' END AS refused FROM customer""",
)
def _(t: Tables):
    """Every customer's own settings over the defaults, and the names that the defaults lack."""
    from tarn import config

    cells = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("min_umis"), F.col("c_mktsegment").alias("separator"), F.when(F.col("c_custkey") % 5 == 0, 1).alias("umis"))
    labels = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") / 100.0).alias("most_q"))
    doc = F.to_json(F.struct(cells.alias("cells"), labels.alias("labels"), F.when((F.col("c_custkey") % 7 == 0) & (F.col("c_custkey") % 5 != 0), "x").alias("other")))
    merged = t.customer.withColumn("doc", doc).withColumn("s", config.settings(F.col("doc")))
    return merged.select("c_custkey", "s.cells.min_umis", "s.distance.percent", "s.labels.most_q", "s.cells.separator", F.array_join(config.unknown(F.col("doc")), ",").alias("refused"))


@query("K05_checks_sink", "SELECT 'n' AS check, true AS passed UNION ALL SELECT 'dear', max(p_retailprice) > 5000 FROM part")
def _(t: Tables):
    """The rows are on disk although the failing one raises."""
    import uuid

    from tarn.operators import checks
    from tarn.sources.storage import shared_folder

    at = f"{shared_folder(t.spark)}/checks-{uuid.uuid4().hex}"
    dear = F.max("p_retailprice")
    rows = checks.measured(t.part, "K05", {"n": (F.count("*"), F.count("*") > 0, "some"), "dear": (dear, dear > 5000, "over 5,000")})
    try:
        checks.written_or_stopped(rows, at)
    except checks.Unmet:
        pass
    return t.spark.read.parquet(at).select("check", "passed")
