from conftest_llm import alnum_words, multiset
from tarn.llm import licenses


def brute(text):
    w = alnum_words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(docs, rows):
    out = licenses.scan(docs)
    assert multiset(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    for r in out.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_fuzzy_notices():
    search = licenses.Search(licenses.NOTICES)
    label = lambda t: licenses.describe(t.encode(), search)[5]
    assert label("This is Licensed undr the Apache Licence, Version 2.0.") == "apache"
    assert label("Released undr the MIT Licence") == "mit"
    assert label("Released under the MTI License") == ""
    assert label("licensed under CC BY-NC 4.0") == "cc-by-nc"
    assert label("nothing of the kind under the sun") == ""


def test_seeds_miss_no_bounded_match():
    import random

    search = licenses.Search(licenses.NOTICES)
    rng = random.Random(4)
    for i, n in enumerate(licenses.NOTICES):
        for _ in range(20):
            t = list(n.text)
            for _ in range(rng.randint(0, n.edits)):
                t[rng.randrange(len(t))] = rng.choice("abcxyz")
            text = "some words before " + "".join(t) + " and after"
            direct = bool(search.patterns[i].search(text))
            assert direct == any(x[3] == n.label for x in search.find(text)) or not direct


def test_empty(no_docs):
    assert licenses.scan(no_docs).count() == 0
