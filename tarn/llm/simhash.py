"""Operator 3, SimHash near-dedup: fuzzy hashing of fingerprint segments by the binary Golay code.

A 64-bit fingerprint splits into three segments. Of two fingerprints that differ in two bits at most, one segment is
equal (pigeonhole), and every other one differs in two bits at most. The Golay code (23, 12) puts each 23-bit word within
three bits of one codeword; two words that are two bits apart always share a codeword within four bits. So the equal
segment together with the codeword indices near the next segment makes keys that such fingerprints share: 3 to 18 of
them, 16 on average. Fingerprints that share a key are joined and verified, and the links' connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import stored, table

#: Words of a shingle, the hash's seed, and the bits in which linked fingerprints differ at most.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Bits of the three segments, from the lowest bit up.
SEGMENTS = (22, 21, 21)
#: Members of a key's group that are compared pair by pair; larger groups meet at the fingerprints one bit away.
PAIRED = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, A-Z lower-cased, over shingles of ``shingle`` words with repeats; 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(rows), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, h, fp``: a hash of the text, and the fingerprint as a signed long, of every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2).cast(pa.binary())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "h", "fp"])

    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words modulo the generator; 0 for codewords."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
    return v


@cache
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error patterns of weight 4 at most, padded to as many as any has, and their number."""
    patterns = np.array([sum(1 << b for b in bits) for k in range(5) for bits in combinations(range(23), k)], np.int64)
    of = _syndrome(patterns)
    order = np.argsort(of, kind="stable")
    patterns, of = patterns[order], of[order]
    first = np.searchsorted(of, np.arange(2048))
    count = np.diff(np.append(first, len(of)))
    return patterns[np.minimum(first[:, None] + np.arange(count.max()), len(patterns) - 1)], count


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned 64-bit fingerprints, ``(place, key)``: keys of the fingerprint at ``place``."""
    errors, count = near_codewords()
    cuts = np.cumsum((0, *SEGMENTS))
    parts = [(fps >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
    places, keys = [], []
    for i, same in enumerate(parts):
        fuzzy = parts[(i + 1) % 3]
        syndrome = _syndrome(fuzzy)
        for k in range(errors.shape[1]):
            has = np.nonzero(count[syndrome] > k)[0]
            index = (fuzzy[has] ^ errors[syndrome[has], k]) >> 11  # the code is systematic: its upper 12 bits number the codewords
            places.append(has)
            keys.append((i << 34) | (same[has] << 12) | index)
    return np.concatenate(places), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy()
        places, keys = golay_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect what fingerprints of ``fps(fp)``, distinct, DISTANCE bits apart at most connect.

    Groups of PAIRED members at most are compared pair by pair. In a larger one every member goes to the 65 words at most
    one bit away; those that meet at a word are two bits apart at most, so each links to the least of them. Two
    fingerprints two bits apart meet at the words between them, so no link is lost, and no group makes all its pairs.
    """
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    keyed = stored(keyed)
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("of"), "n"))
    members = stored(keyed.join(shared, F.col("key") == F.col("of")).select("key", "fp", "n"))
    few = members.where(F.col("n") <= PAIRED).select("key", "fp")
    other = few.select(F.col("key").alias("of"), F.col("fp").alias("other"))
    pairs = few.join(other, (F.col("key") == F.col("of")) & (F.col("fp") < F.col("other"))).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = members.where(F.col("n") > PAIRED).select("fp").distinct()
    bits = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    near = many.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("word"))
    met = near.select("fp", F.min("fp").over(Window.partitionBy("word")).alias("least")).where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges(a, b)``, longs: nodes have the same root if a path connects them.

    Each round every node joins the neighbour, or itself, that comes first in that round's hash order, and the edges move
    to what their ends joined. A constant share of the nodes goes in each round however the ids lie, so the rounds number
    the logarithm of the largest component. Least neighbours are pre-aggregated, and both sides of a join are read
    from written tables, which lets AQE split a node with very many edges.
    """
    e = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots, turn = None, 0
    while not e.isEmpty():
        order = lambda x, turn=turn: F.struct(F.xxhash64(x, F.lit(turn)).alias("o"), F.col(x).alias("id"))
        low = e.groupBy("a").agg(F.min(order("b")).alias("low"))
        joined = stored(low.select(F.col("a").alias("node"), F.least(order("a"), F.col("low"))["id"].alias("to")))
        moved = e.join(joined, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b").join(joined, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        e = stored(moved.where("a != b").distinct())
        if roots is None:
            roots = joined.select("node", F.col("to").alias("root"))
        else:
            roots = stored(roots.join(joined.select(F.col("node").alias("of"), "to"), F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")))
        turn += 1
    return roots if roots is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` for the distinct fingerprints of ``prints(doc_id, fp)``; the least id of the component."""
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    alone = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("of"), "component_id")
    return stored(rooted.join(stored(alone), F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Repeated rows stay repeated, equal texts share a fingerprint, texts without words (null ones too) have fingerprint zero
    and are linked like any other. The component's id is its least doc_id, null ids aside. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    prints = stored(fingerprints(docs, doc_id, text).select("doc_id", "fp"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(grouped(prints), F.col("fp") == F.col("of_fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, of one document a component: that of the least id, then text hash.

    Rows without an id come last; of rows equal in id and text one stays.
    """
    prints = stored(fingerprints(docs, doc_id, text))
    return keep_first(docs, prints, stored(_roots(prints.select("fp").distinct())), doc_id, text)


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The first row of ``docs`` in each component: ``prints(doc_id, h, fp)`` of its rows, ``roots(node, root)`` of the linked ``fp``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    by_fp = prints.groupBy("fp").agg(first)
    groups = stored(by_fp.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*"))
    kept = groups.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"))
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    chosen = whole.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")), "left_semi")
    if prints.count() != prints.select("doc_id", "h").distinct().count():
        chosen = chosen.dropDuplicates(["id", "h"])
    return chosen.select("row.*")


def _roots(fps: DataFrame) -> DataFrame:
    return components(links(fps.select("fp")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = None
