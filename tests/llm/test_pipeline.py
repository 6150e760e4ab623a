import random

import corpus_pipeline
from pyspark.sql import functions as F

from conftest_llm import ws_words
from tarn.llm import secrets
from tarn.llm.shared import stored
from test_decontaminate import brute as brute_hits
from test_near_copies import brute_kept
from test_quality import brute as brute_quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, sf))
        after = docs.collect()
        ids = [r["doc_id"] for r in after]
        if name == "quality_rules":
            assert not any(brute_quality(before[i]["text"])[5] for i in ids)
            assert all(i in ids for i in before if i in bad and not brute_quality(before[i]["text"])[5])
        if name == "near_dedup":
            assert sorted(ids, key=repr) == brute_kept([(i, before[i]["text"]) for i in sorted(before)])
        if name == "decontamination":
            assert sorted(ids) == sorted(i for i in before if not brute_hits(before[i]["text"], items)[4])
        if name == "secret_scan":
            assert sorted(ids) == sorted(before) and not any(secrets.base_spans(r["text"]) for r in after)
        if name == "source_mix":
            assert docs.columns == [*columns, "copy"] and set(ids) <= set(before) and max(ids.count(i) for i in ids) <= 3
            words = sum(len(ws_words(r["text"])) for r in before.values())
            assert abs(sum(len(ws_words(r["text"])) for r in after) - words) < 0.05 * words
        else:
            assert docs.columns == columns and len(set(ids)) == len(ids)


def test_stages_on_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        assert docs.count() == 0, name


def test_stages_on_odd_rows(spark, sf):
    """Null ids, texts and sources, repeated rows, a column that clashes, an empty and a text of several megabytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(21)
    long_ = " ".join(f"{rng.choice(['so', 'then', 'while'])} {rng.getrandbits(40):x}" for _ in range(250_000))
    odd = [(9001, None, "en", "a", 0), (9002, "", "en", None, 0), (None, "no id " + "of its own and some more words " * 3, None, None, 5), (9003, long_, "en", "a", len(long_)), (9003, long_, "en", "a", len(long_))]
    some = docs.limit(40)
    docs = docs.unionByName(some).unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("copy", F.lit("x")).withColumn("row", F.lit(1))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == (columns if name != "source_mix" else [*columns, "copy_"])
        assert 0 < docs.count() <= before or name == "source_mix"
    assert docs.where("doc_id = 9003").count() > 0 and docs.where("doc_id in (9001, 9002)").count() == 0
