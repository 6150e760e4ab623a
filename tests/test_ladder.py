"""The null ladder against a plain version, with strata that are put in order in several runs."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pytest

from tarn.operators import labels


def plain_purity(pairs):
    counts = defaultdict(Counter)
    for cluster, label in pairs:
        if cluster >= 0:
            counts[cluster][label] += 1
    shares = [max(c.values()) / sum(c.values()) for c in counts.values() if sum(c.values()) >= 3]
    return sum(shares) / len(shares)


@pytest.mark.parametrize("run", [40, 10_000])
def test_equals_a_plain_version(spark, monkeypatch, run):
    monkeypatch.setattr(labels, "RUN", run)
    rng, reps = random.Random(1), 12
    rows = [(i, rng.randint(-1, 6), rng.choice("abc") if i % 9 else None, rng.choice([None, 1, 2]), int(i >= 300)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, c int, l string, d int, e int").repartition(3)
    rungs = {"free": [], "d": ["d"], "both": ["d", "e"]}
    got = {r["rung"]: r for r in labels.null_ladder(df, "id", "c", "l", rungs, reps).collect()}
    some = [r for r in rows if r[2] is not None]
    observed = plain_purity([(r[1], r[2]) for r in some])
    for name, strata in rungs.items():
        places, nulls = [{"d": 3, "e": 4}[s] for s in strata], []
        for rep in range(reps):
            groups = defaultdict(list)
            for r in some:
                groups[tuple(r[i] for i in places)].append(r)
            dealt = []
            for g in groups.values():
                order = sorted(g, key=lambda r: (hashlib.md5(f"{r[0]}|{name}|{rep}".encode()).hexdigest(), r[0]))
                dealt += [(x[1], y[2]) for x, y in zip(sorted(g), order, strict=True)]
            nulls.append(plain_purity(dealt))
        mean = statistics.mean(nulls)
        assert abs(got[name]["observed"] - observed) < 1e-12 and abs(got[name]["mean"] - mean) < 1e-12
        assert abs(got[name]["z"] - (observed - mean) / max(statistics.pstdev(nulls), 1e-9)) < 1e-6
