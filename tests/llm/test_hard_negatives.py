import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import multiset
from tarn.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, leaf string, rank string, id string, place int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=10, low=30, high=90, scale=8, dimension=6):
    part = [(i, np.floor(scale * np.array(e, np.float32).astype(float)).astype(int), k) for i, e, k, *_ in rows if i is not None and k is not None and e is not None and len(e) == dimension and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (i, v, k) in enumerate(part):
        if i % 10:
            continue
        scored = sorted((-int(v @ w), j, c) for m, (j, w, c) in enumerate(part) if m != n)
        for s, j in [(-s, j) for s, j, c in scored if c == k][:positives]:
            fits = [(-t, x) for t, x, c in scored if c != k and low * s <= -100 * t <= high * s][:negatives]
            out += [(i, j, r + 1, x, s, t) for r, (t, x) in enumerate(fits)]
    return sorted(out, key=repr)


def made(seed, n, spread=3, labels=4):
    """Coarse vectors, so that scores tie, and odd rows among them."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-spread, spread + 1, 6) / 8).tolist(), int(rng.integers(0, labels))) for i in range(n)]
    rows += [rows[10], rows[10], rows[7], (None, [0.25] * 6, 1), (n, None, 1), (n + 1, [0.5] * 6, None), (n + 2, [], 1), (n + 3, [0.5] * 5, 1), (n + 4, [None] + [0.5] * 5, 1), (n + 5, [float("nan")] * 6, 1), (n + 6, [float("-inf")] * 6, 1), (0, [0.0] * 6, 1)]
    return [(*r, "u", "l", "r", "i", 1) for r in rows]


def run(spark, rows, **more):
    return hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("label"), F.col("vec_id") % 10 == 0, scale=8, **more)


@pytest.mark.parametrize(("n", "spread", "labels"), [(400, 3, 4), (150, 1, 2), (60, 4, 30)])
def test_equals_brute_force(spark, n, spread, labels):
    rows = made(n, n, spread, labels)
    assert multiset(run(spark, rows), *COLUMNS) == brute(rows)


def test_groups_leaves_and_merges_give_the_same(spark, monkeypatch):
    """Anchors in several groups, small leaves, a small sample and lists merged often."""
    rows = made(3, 300)
    for name, value in (("GROUP", 7), ("LEAF", 8), ("ANCHOR_LEAF", 3), ("HELD", 20), ("SAMPLE", 30)):
        monkeypatch.setattr(hn, name, value)
    assert multiset(run(spark, rows, positives=3, negatives=4, low=10, high=100), *COLUMNS) == brute(rows, 3, 4, 10, 100)


def test_one_common_vector(spark):
    """A third of all rows alike, in two labels."""
    rows = made(9, 200) + [(1000 + i, [0.25] * 6, i % 2, "", "", "", "", 0) for i in range(150)]
    assert multiset(run(spark, rows), *COLUMNS) == brute(rows)


def test_nothing_to_find(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("label"), F.lit(True)).count() == 0
    assert run(spark, [(10, [0.5] * 6, 1, "", "", "", "", 0)]).count() == 0  # an anchor without others
    assert run(spark, [(11, [0.5] * 6, 1, "", "", "", "", 0)]).count() == 0  # no anchor


def test_scores_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="inner products"):
        run(spark, [(10 * i, [1e9] * 6, 1, "", "", "", "", 0) for i in range(5)]).count()


def test_whole_groups_are_pruned(monkeypatch):
    """Grouped vectors leaves no larger than a group, rows that lie together as _by_leaf leaves them: few pairs of rows are scored, and the lists are the true ones."""
    for name, value in (("LEAF", 16), ("ANCHOR_LEAF", 8), ("HELD", 2_000)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(40, 16))[np.arange(4000) // 100] * 300 + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    uid, labels = np.arange(4000), np.arange(4000) % 7
    mine = np.arange(0, 4000, 10)
    search = hn.Search(v[mine], uid[mine], labels[mine], 1, 5, np.full(400, hn.LOWEST + 1), np.full(400, hn.NONE), True)
    lists = hn.Lists(400, 5, search.floor)
    scored = sum(search.scan(lists, v[low : low + 1000], uid[low : low + 1000], uid[low : low + 1000], labels[low : low + 1000]) or lists.merge() or 0 for low in range(0, 4000, 1000))
    lists.merge()
    for a, n in enumerate(mine):
        s = v @ v[n]
        best = sorted((-int(s[m]), m) for m in range(4000) if m != n and labels[m] == labels[n])[:5]
        assert [(-int(x), int(i)) for x, i in zip(lists.scores[a], lists.ids[a], strict=True)] == best
    assert 0 < scored < 0.25 * 400 * 4000
