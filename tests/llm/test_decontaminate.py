import hashlib
import random
from collections import Counter

from conftest_llm import alnum_words, multiset
from tarn.llm import decontaminate


def brute(text, items, size=10):
    w = alnum_words(text)
    hit, named = set(), set()
    for item, body in items:
        b = alnum_words(body)
        for window in [b[k : k + size] for k in range(max(1, len(b) - size + 1))] if b else []:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    named |= {str(item)} - {"None"}
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def items_of(rows):
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 20000)
    w = long.split()
    return [
        (1, " ".join(w[50:75])), (2, " ".join(w[60:70])), (2, " ".join(w[60:70])), (3, "One two"), (10, "THREE"), (4, ""), (5, None), (6, "not in any text of these at all my friend no no"),
        (7, "the the the the the the the the the the the the"), (None, "one"), (8, " ".join(w[300:330]) + " absent-word"), (9, "line one here line one here line two line one here"),
    ]


def test_equals_brute_force(spark, docs, rows):
    items = items_of(rows)
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert multiset(got, *COLUMNS) == sorted(((r[0], *brute(r[1], items)) for r in rows), key=repr)


def test_empty_tables(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == len(rows)
    assert decontaminate.decontaminate(no_docs, spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0


def test_keep_clean(spark, docs, rows):
    items = items_of(rows)
    kept = decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert multiset(kept, "doc_id") == sorted(((r[0],) for r in rows if not brute(r[1], items)[4]), key=repr)


def test_items_without_id_contaminate(spark):
    text = " ".join(f"w{i}" for i in range(60))
    items = [(None, text)]
    docs = spark.createDataFrame([(1, "so " + text), (2, "clean")], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert multiset(got, *COLUMNS) == sorted(((r["doc_id"], *brute(r["text"], items)) for r in docs.collect()), key=repr)
    assert decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()[0]["doc_id"] == 2


def brute_near(texts, items, size=10, slack=decontaminate.SLACK):
    """Windows whose terms all stand within ``slack`` of their places, the rarest term in its own."""
    split = [alnum_words(t) for t in texts]
    n = Counter(w for s in split for w in s)
    windows = {tuple(b[k : k + size]) for b in map(alnum_words, items) for k in range(max(1, len(b) - size + 1)) if b}
    out = []
    for s in split:
        near = 0
        for w in windows:
            at = min(range(len(w)), key=lambda k: (n[w[k]], k))
            near += any(s[p] == w[at] and all(w[k] in s[max(0, p - at + k - slack) : max(0, p - at + k + slack + 1)] for k in range(len(w))) for p in range(len(s)))
        out.append(near)
    return out


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 25))) for _ in range(8)]
    texts = ["", None, items[0]]
    for _ in range(60):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            w = w or ["x"]
        if rng.random() < 0.3 and len(w) > 2:
            k = rng.randrange(len(w) - 1)
            w[k], w[k + 1] = w[k + 1], w[k]
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + w + rng.choices(vocabulary, k=rng.randint(0, 40))))
    got = decontaminate.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).orderBy("doc_id").collect()
    want = brute_near(texts, items)
    assert [r["n_near"] for r in got] == want and sum(want) > sum(r["n_hit"] > 0 for r in got) > 0
