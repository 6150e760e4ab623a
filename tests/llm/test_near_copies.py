import random

import corpus_pipeline
from conftest_llm import LOWER, ws_words
from tarn.llm import near_copies


def shingle_set(text):
    w = ws_words((text or "").translate(LOWER))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The least id of each component of texts whose five-word sets have a Jaccard similarity of 0.8 or more."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((least.get(r) for r in {find(i) for i in range(len(rows))}), key=repr)


def kept(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def test_stage_equals_brute_force_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = kept(corpus_pipeline.near_dedup(spark, docs, sf))
    assert got == brute_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert 177 not in got and 145 not in got  # 11 and 7 bits from documents 1 and 6


def test_odd_rows(docs, rows):
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and kept(got) == brute_kept([r[:2] for r in rows])


def test_large_group_of_copies_with_changed_words(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(8)):
            w[k] = f"x{i}y{k}" if i % 3 else f"z{k}"
        rows.append((i, " ".join(w)))
    want = brute_kept(rows)
    assert 1 < len(want) < 250
    assert kept(near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_empty(no_docs):
    assert near_copies.keep_one(no_docs).count() == 0


def test_copies_just_below_the_similarity_dont_make_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for at in (0, 1000):
        base = [f"w{at + rng.randrange(400)}" for _ in range(120)]
        for i in range(at, at + 400):
            w = list(base)
            for k in rng.sample(range(120), rng.choice((1, 2, 3, 3, 3, 4))):
                w[k] = f"x{i}y{k}" if i % 4 else f"z{k}"
            rows.append((i, " ".join(w)))
    compared, verified = [], near_copies.verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "verified", counted)
    assert kept(near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_kept(rows)
    assert len(compared) == 2 and compared[1] < 5 * len(rows)


def test_a_large_group_makes_few_edges(spark, monkeypatch):
    """Copies that share many keys: families are of components, and found links go on as stars."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for k in rng.sample(range(120), rng.choice((1, 1, 1, 2, 2, 3))):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    edges, components = [], near_copies.components

    def counted(e):
        edges.append(e.count())
        return components(e)

    monkeypatch.setattr(near_copies, "components", counted)
    assert kept(near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_kept(rows)
    assert len(edges) == 3 and max(edges[1:]) < 3 * len(rows), edges


def test_families_equal_brute_force(spark):
    rng = random.Random(7)
    sets = {}
    for node in range(240):
        base = range(1000 * (node % 3), 1000 * (node % 3) + (90, 100, 12)[node % 3])
        out = set(rng.sample(base, rng.randrange(0, 10 if len(base) > 20 else 3)))
        sets[node] = sorted({*base} - out | {10_000 + rng.randrange(60 if node % 2 else 100_000) for _ in range(rng.randrange(8 if len(base) > 20 else 2))})
    sets[240], sets[241] = [7], [7, *range(500, 530)]
    similar = {(a, b) for a in sets for b in sets if a < b and 9 * len({*sets[a]} & {*sets[b]}) >= 4 * (len(sets[a]) + len(sets[b]))}
    for family in (lambda node: 0, lambda node: node % 3):
        relatives = spark.createDataFrame([(family(n), n, n) for n in sets], "family long, node long, root long")
        found = {tuple(sorted(r)) for r in near_copies.apart(relatives, spark.createDataFrame(list(sets.items()), "node long, items array<long>")).collect()}
        within = {(a, b) for a, b in similar if family(a) == family(b)}
        assert found <= within
        roots = {}

        def find(x, roots=roots):
            while roots.setdefault(x, x) != x:
                x = roots[x]
            return x

        for a, b in found:
            roots[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in within)
