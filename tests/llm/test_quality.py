import re
from collections import Counter

from pyspark.sql import functions as F

from conftest_llm import multiset, ws_words
from tarn.llm import quality


def brute(text):
    t = text or ""
    w = ws_words(t)
    n, seen, dup = len(w), set(), 0
    for line in t.split("\n"):
        if ws_words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    covered = {p for k in range(n - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_equals_brute_force(docs, rows):
    got = multiset(quality.judge(docs, quality.DecisionList()), "doc_id", *BASE)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(no_docs, quality.learn(no_docs, labels)).count() == 0
    assert quality.keep_good(no_docs, quality.DecisionList()).columns == no_docs.columns


def test_learns_a_pure_conjunction(spark):
    import random

    rng = random.Random(3)
    rows = [(x := rng.random(), y := rng.random(), x > 0.7 and y < 0.4, i % 3 == 0) for i in range(1500)]
    found = quality.fit(spark.createDataFrame(rows, "a double, b double, bad boolean, apart boolean"), ["a", "b"])
    df = spark.createDataFrame(rows, "a double, b double, bad boolean, apart boolean")
    hit = df.withColumn("hit", found.fired({"a": F.col("a"), "b": F.col("b")}).isNotNull()).groupBy("bad", "hit").count().collect()
    n = {(r["bad"], r["hit"]): r["count"] for r in hit}
    assert n.get((False, True), 0) <= 0.02 * n[(True, True)] and n[(True, True)] > 0.7 * (n[(True, True)] + n.get((True, False), 0))


def test_one_class_gives_no_rules(spark):
    df = spark.createDataFrame([(1.0, False, False), (2.0, False, True)], "a double, bad boolean, apart boolean")
    assert quality.fit(df, ["a"]).rules == []


def test_query_finds_bad_labels_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = {(r[0], r[1]): r[2] for r in out.join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n[(0, False)] > 4 * n.get((0, True), 0)


def test_held_out_labels(spark):
    """A list learned from two thirds of the labels, asked about the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    third = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    judged = quality.judge(docs, quality.learn(docs, labels.where(~third))).join(labels.where(third), "doc_id").where(~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    rejected, right, bad = n.get((0, False), 0) + n.get((1, False), 0), n.get((0, False), 0), n.get((0, False), 0) + n.get((0, True), 0)
    print("held out:", n)
    assert right >= 0.95 * rejected and right >= 0.7 * bad > 0


def test_ties_of_labels_and_null_labels(spark):
    """Several labels of an id count with the lowest; rows without a quality teach nothing."""
    docs = spark.createDataFrame([(i, ("word " * 30) + ("# " * 40 if i % 2 else f"a{i} b c d e f")) for i in range(60)], "doc_id long, text string")
    labels = [(i, 0 if i % 2 else 1) for i in range(60)]
    plain = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    tied = quality.learn(docs, spark.createDataFrame(labels + [(i, 1) for i in range(60)] + [(0, None), (None, 0)], "doc_id long, quality int"))
    assert plain.rules == tied.rules


def test_keep_good_keeps_columns_and_rows(docs):
    rules = quality.DecisionList([[quality.Condition("symbols_per_word", True, 0.3)]])
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert multiset(kept, "doc_id") == multiset(quality.judge(docs, rules).where("kept"), "doc_id")
