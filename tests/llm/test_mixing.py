from collections import defaultdict

from conftest_llm import multiset, ws_words
from tarn.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
        left = sum(sizes.values()) - sum(target.values())
        if not free:
            break
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    return target


def check(df, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(ws_words(r[1]))
    want = brute_targets(sizes)
    out = mixing.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(r[0]), len(ws_words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    return want, taken


def test_targets_and_taken(docs, rows):
    want, taken = check(docs, rows)
    for s in want:  # a document larger than the target can't be divided
        largest = max(len(ws_words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= max(largest / 2 if largest > want[s] else 60, 0.03 * want[s]), (s, want[s], taken[s])


def test_small_sources_are_capped_and_reruns_agree(spark):
    rows = [(i, "a " * (i % 17 + 1), "en", "tiny" if i < 5 else "big" if i < 400 else "mid", 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want, taken = check(df, rows)
    assert want["tiny"] == taken["tiny"] == 3 * sum(i % 17 + 1 for i in range(5))
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    assert multiset(mixing.mix(df), "doc_id", "taken") == multiset(mixing.mix(df.repartition(7)), "doc_id", "taken")


def test_expand_repeats_rows(docs):
    out = mixing.expand(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert out.count() == mixing.mix(docs).agg({"copies": "sum"}).first()[0]


def test_many_sizes_and_many_sources(spark):
    """A source of 3,000 sizes, beyond those that carry the error, and 2,000 small sources."""
    big = [(i, "a " * (i % 3_000 + 1), "en", "big", 0) for i in range(4_000)]
    small = [(10_000 + i, "a " * (i % 40 + 1), "en", f"s{i % 2_000:04d}", 0) for i in range(12_000)]
    df = spark.createDataFrame(big + small, "doc_id long, text string, lang string, source string, n_chars long")
    want, taken = check(df, big + small)
    assert abs(taken["big"] - want["big"]) <= 2
    assert all(abs(taken[s] - want[s]) <= max(40, 0.03 * want[s]) for s in want)


def test_rows_equal_in_everything_share_their_copies(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 40 + [(2, "a b c d", "en", "s", 7), (3, "x " * 30, "en", "t", 60), (3, "x " * 30, "de", "t", 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long").repartition(4)
    out = mixing.expand(df)
    assert out.columns == [*df.columns, "copy_"]
    assert out.count() == mixing.mix(df).agg({"copies": "sum"}).first()[0]
    assert out.where("copy_ < 1 or copy_ > 3").count() == 0


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.expand(no_docs).count() == 0
