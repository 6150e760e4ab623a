import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import LOWER, ws_words
from tarn.llm import ctw


def slow_log10(train: list[bytes], text: bytes, depth: int) -> float:
    """CTW over bytes by the definition: a node for every context and partial byte, block probabilities bottom up."""
    counts, children = Counter(), defaultdict(set)
    for t in train:
        b = bytes(depth) + t + b"\0"
        for i in range(depth, len(b)):
            for bit in range(8):
                node = (1 << bit) | b[i] >> (8 - bit) if bit else 1
                for d in range(depth + 1):
                    counts[(b[i - d : i], node, b[i] >> (7 - bit) & 1)] += 1
                    if d:
                        children[b[i - d + 1 : i], node].add(b[i - d : i])

    def kt(s, node):
        z, o = counts[(s, node, 0)], counts[(s, node, 1)]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1), (o + 0.5) / (z + o + 1)

    known = {}

    def weighted(s, node):
        if (s, node) not in known:
            own = kt(s, node)[0]
            if len(s) < depth:
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, node) for c in children[s, node]))
            known[s, node] = own
        return known[s, node]

    def one(context, node):
        p = kt(context, node)[1]
        for d in range(depth - 1, -1, -1):
            s = context[depth - d :]
            own, q = kt(s, node)
            w = math.exp(math.log(0.5) + own - weighted(s, node))
            p = w * q + (1 - w) * p
        return p

    total, b = 0.0, bytes(depth) + text + b"\0"
    for i in range(depth, len(b)):
        for bit in range(8):
            p = one(b[i - depth : i], (1 << bit) | b[i] >> (8 - bit) if bit else 1)
            total += math.log10(p if b[i] >> (7 - bit) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("depth", [1, 3, 5, 6])
def test_scores_equal_the_definition(spark, depth):
    rng = random.Random(4)
    texts = ["abab abba", "abab", "", "é", None, "zq a", "éa", *(" ".join(rng.choices(["the", "then", "cat", "sat", "Über"], k=rng.randint(1, 30))) for _ in range(12))]
    rows = list(enumerate(texts))
    train = [(t or "").translate(LOWER).encode() for i, t in rows if not ctw.held_out(i)]
    assert 0 < len(train) < len(rows)
    for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect():
        assert abs(r["score"] - slow_log10(train, (texts[r["doc_id"]] or "").translate(LOWER).encode(), depth)) < 1e-6, r


def test_log_kt_over_all_sizes(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 2), (0, 50), (17, 4000), (10**6, 3), (10**7, 10**7)]
    got = spark.createDataFrame(pairs, "z long, o long").select("z", "o", ctw.log_kt(F.col("z"), F.col("o"))).collect()
    for z, o, x in got:
        assert abs(x - (math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1))) < 1e-7


def test_grams_in_blocks(monkeypatch):
    text = "über straße 123".encode()
    whole = np.concatenate(list(ctw.grams(text)))
    monkeypatch.setattr(ctw, "BLOCK", 4)
    assert np.array_equal(np.concatenate(list(ctw.grams(text))), whole) and len(whole) == len(text) + 1


def test_scores_equal_brute_force(docs, rows):
    tokens = lambda t: [*ws_words((t or "").translate(LOWER)), None]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), out(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in ctw.score(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 2e-6 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))


def test_chunks_of_any_size_give_the_same_scores(docs, monkeypatch):
    found = lambda: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in ctw.score(docs).collect())
    whole = found()
    monkeypatch.setattr(ctw, "CHUNK", 500)
    monkeypatch.setattr(ctw, "BUCKET", 300)
    monkeypatch.setattr(ctw, "HEAVY", 100)
    for a, b in zip(found(), whole, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 and abs(a[3] - b[3]) < 2e-6


def test_held_out_texts_beat_shuffled_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = ctw.score(docs).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]
    shuffled = docs.rdd.map(lambda r: (r["doc_id"], "".join(random.Random(1).sample(r["text"] or "", len(r["text"] or "")))) if ctw.held_out(r["doc_id"]) else (r["doc_id"], r["text"])).toDF("doc_id long, text string")
    assert scored < 3.2 < ctw.score(shuffled).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]


def test_empty(no_docs):
    assert ctw.score(no_docs).count() == 0


def test_no_training_text(spark):
    held = next(i for i in range(50) if ctw.held_out(i))
    r = ctw.score(spark.createDataFrame([(held, "abc abc")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0)
    assert abs(r["bits_per_byte"] - 8) < 1e-4


def test_tokens_of_a_chunk_stay_in_arrays():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    texts = [None, "", " \t a  B\x0bb\x0c\r\nÄ Ä x ", *[" ".join(f"t{rng.randrange(10**9)}" for _ in range(1000)) for _ in range(100)]]
    docs = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    words = [(t or "").encode().translate(LOWER if isinstance(LOWER, bytes) else ctw._LOWER).split() for t in texts]
    found, owner = ctw.split(docs.column(1))
    assert found.to_pylist() == [w for ws in words for w in ws] and owner.tolist() == [i for i, ws in enumerate(words) for _ in ws]

    near = Counter(w for i, ws in enumerate(words) if not ctw.held_out(i) for w in [*ws, ctw.END_TOKEN])
    packs = pa.chunked_array([pa.array([ctw._packed(docs.slice(0, 50)), ctw._packed(docs.slice(50))], pa.binary())])
    tracemalloc.start()
    values, logs = ctw._valued(packs, pa.array([b"b", b"elsewhere"], pa.binary()), np.array([7.0, 8.0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(near)  # a dict of as many takes 150 bytes each and more
    got = dict(zip(values.to_pylist(), logs.tolist(), strict=True))
    assert len(got) == len(values) and got.pop(b"elsewhere") == 8.0 and got.pop(b"b") == 7.0
    near.pop(b"b", None)
    assert got == pytest.approx({w: math.log10(c + 1) for w, c in near.items()})


def test_memory_of_a_bucket():
    import tracemalloc

    found = np.unique(np.random.default_rng(1).integers(0, 1 << 48, ctw.BUCKET))
    tracemalloc.start()
    ctw.subtrees(found, np.ones(len(found)), 5, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
