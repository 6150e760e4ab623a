import random

import numpy as np
import xxhash

from conftest_llm import LOWER, multiset, ws_words
from tarn.llm import simhash


def brute_fingerprint(text):
    w = ws_words((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, one_each=False):
    """The component's least id for every row; ``one_each``: for every component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in {find(i) for i in range(len(ids))}] if one_each else [least.get(find(i)) for i in range(len(ids))]


def test_equals_brute_force(docs, rows):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps), strict=True), key=repr)
    assert multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_golay_patterns_are_those_of_a_perfect_code():
    patterns, count = simhash.near_codewords()
    assert set(count) == {1, 6} and (count == 6).sum() == 1771
    assert all(simhash._syndrome(patterns[:, 0]) == np.arange(2048))


def test_two_bits_apart_share_a_key():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        keys = [set(simhash.golay_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_large_groups_keep_their_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:  # many share keys; chains of two-bit steps
        x = rng.choice(sorted(fps)) if rng.random() < 0.3 else centre
        for bit in rng.sample(range(64), 2):
            x ^= 1 << bit
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r["of_fp"]: r["component_id"] for r in simhash.grouped(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()}
    assert [got[x] for x in signed] == brute_components(list(range(len(fps))), fps)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == 303


def test_keep_one_keeps_one_row_a_component(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted(brute_components(ids, fps, one_each=True), key=repr)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
