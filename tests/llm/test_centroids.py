import hashlib

import numpy as np
import pytest

from conftest_llm import multiset
from tarn.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string, v string, distance string"


def brute(rows, k, rounds, dimension, scale):
    kept = [(i, np.floor(scale * np.array(e, np.float32).astype(float)).astype(int)) for i, e, *_ in rows if e is not None and len(e) == dimension and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1].tolist()))[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        members = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(centres))]
        centres = [sum(m) // len(m) if m else c for m, c in zip(members, centres, strict=True)]
    each = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in each if j == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for i, d, j in each), key=repr)


def made(seed, n, dimension=5, spread=2):
    """Few distinct values, so that distances tie; odd rows among them."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-spread, spread + 1, dimension) / 4).tolist()) for i in range(n)]
    rows += [rows[3], rows[3], (None, [0.25] * dimension), (n, None), (n + 1, []), (n + 2, [0.5] * (dimension - 1)), (n + 3, [None] + [0.5] * (dimension - 1)), (n + 4, [float("nan")] * dimension), (n + 5, [float("inf")] * dimension), (3, [0.75] * dimension)]
    return [(*r, 1, "c", "i", "v", "d") for r in rows]


@pytest.mark.parametrize(("n", "k", "rounds", "spread"), [(300, 16, 3, 2), (40, 7, 6, 1), (5, 16, 3, 1), (120, 1, 2, 3)])
def test_equals_brute_force(spark, n, k, rounds, spread):
    rows = made(n + k, n, spread=spread)
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dimension=5, scale=4)
    assert multiset(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == brute(rows, k, rounds, 5, 4)


def test_no_rows(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA)).count() == 0


def test_too_wide_raises(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, "", "", "", "")], SCHEMA)).count()


def test_bounds_hold_and_prune():
    """Through moving centroids the bounds stay bounds, the winners are the nearest, and few rows are opened."""
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(16, 8))[np.arange(2000) % 16] * 400 + rng.normal(size=(2000, 8)) * 20).astype(np.int64)
    centres = v[:16].copy()  # one of each group
    own, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros(2000)
    for _ in range(5):
        own, upper, lower = centroids.exponion(v, own, upper, lower, centres)
        d = ((v[:, None] - centres[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        rest = np.sqrt(np.where(np.arange(16) == own[:, None], np.iinfo(np.int64).max, d).min(1))
        assert (np.sqrt(d.min(1)) <= upper).all() and (lower <= rest).all()
        new = np.array([v[own == j].mean(0) if (own == j).any() else centres[j] for j in range(16)]).astype(np.int64)
        moved = np.sqrt(((new - centres) ** 2).sum(1))
        others = np.array([np.delete(moved, a).max() for a in range(16)])
        upper, lower, centres = (upper + moved[own]) * (1 + 1e-9), np.maximum(lower - others[own], 0) * (1 - 1e-9), new
    assert (upper < lower).mean() > 0.9
