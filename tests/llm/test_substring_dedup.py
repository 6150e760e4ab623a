import random
import re
from collections import defaultdict

from tarn.llm import substring_dedup as sd


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n)]


def planted(seed=3):
    rng = random.Random(seed)
    passage, constant = words(rng, 55), ["der"] * 80
    docs = [(i, " ".join(words(rng, rng.randint(30, 300)))) for i in range(30)]
    for i in (2, 9, 17):
        w = docs[i][1].split()
        at = rng.randint(0, len(w))
        docs[i] = (i, " ".join(w[:at] + passage + w[at:]))
    docs[20] = (20, " ".join(words(rng, 10) + constant))
    docs[21] = (21, " ".join(words(rng, 13) + constant[:60]))
    docs += [(50, docs[4][1]), (51, "  ".join(docs[5][1].split())), (60, None), (61, ""), (62, "short text"), (None, docs[6][1]), (63, docs[7][1].replace(" ", " ", 1) + " tail of its own")]
    return docs


def test_planted_passages_and_no_others(spark):
    docs = planted()
    df = spark.createDataFrame([(*d, 0, 0, "c") for d in docs], "doc_id long, text string, digest long, place long, row string")
    got = sd.repeated_spans(df).collect()
    assert {r["doc_id"] for r in got} == {2, 9, 17, 20, 21, 4, 50, 5, 51, 7, 63, 6, None}
    text = dict(docs)
    held = {r["doc_id"]: {tuple(text[r["doc_id"]].split()[k : k + sd.LEAST]) for k in range(len(text[r["doc_id"]].split()))} for r in got}
    for r in got:
        span = text[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        assert len(span) == r["n_words"] >= sd.LEAST
        assert any(tuple(span[: sd.LEAST]) in held[o] for o in held if o != r["doc_id"])
        assert r["doc_id"] is None or r["first_doc_id"] <= r["doc_id"]


def test_recall_of_51_words_over_all_positions():
    """Two copies between different neighbours share a run of pairs of LEAST words, in 99 of 100 cases at least."""
    rng = random.Random(8)
    missed = 0
    for _ in range(400):
        p, found = words(rng, 51), []
        for _ in range(2):
            before = words(rng, rng.randint(5, 40))
            start, end, digest, _ = sd.chunks(" ".join(before + p + words(rng, rng.randint(5, 40))).encode())
            found.append({d: (a - len(before), b - len(before)) for a, b, d in zip(start, end, digest, strict=True)})
        both = sorted(found[0][d] for d in found[0].keys() & found[1].keys())
        missed += not both or max(b for _, b in both) - both[0][0] < sd.LEAST
    assert missed <= 4


def test_spans_are_repeated_word_by_word(spark):
    """Every word of a span lies in a run of words that another document holds too; a brute-force n-gram index says so."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    n = sd.NEIGHBOURS + 1
    held = defaultdict(set)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    got = sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) > 20
    for r in got:
        w = split[r["doc_id"]]
        runs = [k for k in range(r["start_word"], r["end_word"] - n + 1) if held[tuple(w[k : k + n])] - {r["doc_id"]}]
        assert {p for k in runs for p in range(k, k + n)} == set(range(r["start_word"], r["end_word"])), r


def test_strip_keeps_one_copy_of_overlapping_passages(spark):
    rng = random.Random(5)
    x, y, z = (words(rng, 60) for _ in range(3))
    own = [words(rng, 40) for _ in range(3)]
    docs = [(3, own[0] + x + y), (5, own[1] + x + y + z), (9, own[2] + y + z)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in sd.strip_repeats(df).collect()}
    for part in (x, y, z, *own):
        assert any(set(part) <= set(w) for w in left.values()) or all(any(p in w for w in left.values()) for p in part)
    assert left[3] == own[0] + x + y and len(left[5]) < 40 + 60 + 30 and len(left[9]) < 40 + 30
    assert left[9][:40] == own[2]


def test_ids_of_text_and_none_and_very_long_texts(spark):
    rng = random.Random(6)
    p, long_ = words(rng, 80), words(rng, 400_000)  # some 2.4 MB
    rows = [("b", " ".join(words(rng, 30) + p)), (None, " ".join(words(rng, 20) + p)), ("a", " ".join(long_)), (None, " ".join(words(rng, 9) + long_[200_000:200_100])), ("c", "der " * 50_000), ("d", "die " + "der " * 300), ("b", "another text of one id " + " ".join(p))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["first_doc_id"]): r["n_words"] for r in sd.repeated_spans(df).collect()}
    assert got.keys() == {("b", "b"), (None, "b"), ("a", "a"), (None, "a"), ("c", "c"), ("d", "c")}
    left = sd.strip_repeats(df).collect()
    assert len(left) == len(rows) and [len(r["text"].split()) for r in left if r["doc_id"] in ("a", "c")] == [400_000, 50_000]


def test_strip_repeats(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in sd.strip_repeats(df).collect()}
    assert len(out) == len(docs) and out[2] == dict(docs)[2] and len(out[9].split()) <= len(dict(docs)[9].split()) - sd.LEAST
    assert out[50] == "" and out[60] is None and out[62] == "short text" and set(out[9].split()) <= set(dict(docs)[9].split())


def test_empty(spark, no_docs):
    assert sd.repeated_spans(no_docs).count() == 0
