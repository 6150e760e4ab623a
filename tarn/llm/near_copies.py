"""Operator 3 by similarity, the pipeline's near-duplicate stage: Golay keys of long fingerprints, verified by Jaccard similarity.

A text's set holds the hashes of its runs of SHINGLE words. Texts of similarity 0.8 differ in some 15 % of the bits of a
SimHash, so the fingerprint here has TABLES segments of 23 bits: pigeonhole leaves some of them few errors. Two segments
that differ in two bits at most always share a codeword of the Golay code within four bits of both; at 15 % of differing
bits 61 % of them do. Each segment gives as many keys as it has near codewords, five on average, and a key also holds two
minhashes of the set (both agree with probability 0.64), so that random texts don't meet. A pair of similarity 0.8 shares
no key of any segment with probability (1 - 0.64 * 0.61) ** 16 = 4e-4, a more similar one less often.

Sets that share a key and whose fingerprints differ in few enough bits (FAR) are verified on the whole sets. Small groups
are compared within; in larger ones every member is compared with the group's pivot alone. The components of these links
go on as stars, and those that the keys of larger groups connect make a family. Its sets are told by how they differ from
the items that most of the family has: two of them differ from each other where exactly one of them differs from those. So
sets that differ little from them are linked outright, and others are compared only if they meet at one of their rarest
differences.
That join loses no pair of a family, whatever the keys and fingerprints are, and copies of one text don't make all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import stored
from tarn.llm.simhash import _LOWER, _syndrome, SEED, components, keep_first, near_codewords

#: Words of a shingle, and the similarity of linked texts as a fraction: 4 / 5.
SHINGLE, SHARE, OF = 5, 4, 5
#: Segments of 23 bits, the 64-bit words that hold them, and the minhashes in a key.
TABLES, WORDS, ANCHORS = 16, 6, 2
#: Bits in which fingerprints of candidates differ at most. 0.8 makes 58 of 384 on average and 72 in texts of ten words,
#: with a deviation of 7; unrelated texts differ in 192 with a deviation of 10. Sets of SMALL items or more have the lower bound.
FAR, FARTHEST, SMALL = 95, 112, 40
#: Members of a key's group that are compared pair by pair at once.
PAIRED = 8
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS + TABLES * ANCHORS), np.uint64)
_XOR, _TIMES = _DRAWS[0], _DRAWS[1] * np.uint64(2) + np.uint64(1)
_PRINT = [f"p{k}" for k in range(WORDS)]
#: Items that are hashed at once, and whose bits are counted in one byte each at once: below 256.
_BLOCK, _BYTE = 4080, 255
#: For each byte its eight bits as the bytes of a long.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's runs of ``shingle`` words, A-Z lower-cased; of all its words if they are fewer."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        runs = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        runs = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(runs, ">u8").astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint as WORDS longs, and the minhashes, of a set that isn't empty.

    A fingerprint's bit is 1 if it is set in over half of the set's hashes, each hashed anew for every 64 bits.
    """
    ones, least = np.zeros(WORDS * 64, np.int64), np.full(TABLES * ANCHORS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        h = (hashes[i : i + _BLOCK, None] ^ _XOR) * _TIMES
        spread = _SPREAD[_mixed(h[:, :WORDS]).view(np.uint8)]
        for k in range(0, len(spread), _BYTE):
            ones += spread[k : k + _BYTE].sum(0).view(np.uint8)
        least = np.minimum(least, h[:, WORDS:].min(0))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64), least


def golay_keys(prints: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints and minhashes of several sets, ``(place, key)``: the keys of the set at ``place``, in its order."""
    errors, count = near_codewords()
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, : TABLES * 23]
    segments = bits.reshape(-1, TABLES, 23).astype(np.int64) @ (1 << np.arange(23, dtype=np.int64))
    tables = anchors.reshape(-1, TABLES, ANCHORS)
    where = np.arange(1, TABLES + 1, dtype=np.uint64)[None, :]
    anchor = where
    for k in range(ANCHORS):
        anchor = _mixed(anchor * np.uint64(0x9E3779B97F4A7C15) ^ tables[:, :, k])
    of = _syndrome(segments)
    places, keys = [], []
    for k in range(errors.shape[1]):
        place, table = np.nonzero(count[of] > k)
        index = (segments[place, table] ^ errors[of[place, table], k]) >> 11
        places.append(place)
        keys.append(_mixed(anchor[place, table] + index.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    place, key = np.concatenate(places), np.concatenate(keys)
    order = np.argsort(place, kind="stable")
    return place[order], key[order].view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, fp, n, p0, ..., anchors`` of every row: a hash of the text, one of its set of shingles, the set's size,
    the words of its fingerprint and its minhashes; zeros and null without words."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, prints, anchors = [], [], np.zeros((b.num_rows, WORDS), np.uint64), []
            for i, t in enumerate(b.column(2).cast(pa.binary())):
                s = shingles(t.as_py())
                ids.append(_set_id(s))
                sizes.append(len(s))
                least = None
                if len(s):
                    prints[i], least = sketch(s)
                anchors.append(None if least is None else least.tobytes())
            words = [pa.array(np.ascontiguousarray(p).view(np.int64)) for p in prints.T]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *words, pa.array(anchors, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "h", "fp", "n", *_PRINT, "anchors"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, h long, fp long, n long, {', '.join(f'{p} long' for p in _PRINT)}, anchors binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """``key, node`` for ``nodes(node, p0, ..., anchors)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints = np.stack([b.column(k + 1).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
                place, key = golay_keys(prints, np.frombuffer(b"".join(b.column(WORDS + 1).to_pylist()), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(place))], ["key", "node"])

    return nodes.select("node", *_PRINT, "anchors").mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``node, items`` for the texts of which ``wanted(w)`` has the hash."""
    own = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(wanted, F.col("h") == F.col("w"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "items"])

    return own.dropDuplicates(["h"]).select("text").mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose sets have a Jaccard similarity of SHARE / OF or more, in whole numbers."""
    left, right = sets.select(F.col("node").alias("na"), F.col("items").alias("ia")), sets.select(F.col("node").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    shared = F.size(F.array_intersect("ia", "ib"))
    return both.where(shared * (SHARE + OF) >= (F.size("ia") + F.size("ib")) * SHARE).select("a", "b")


def _near(a: str, b: str) -> Column:
    """Whether members with the prefixes ``a`` and ``b`` may be similar by their sizes and fingerprints."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(WORDS)])
    return (F.least(f"{a}n", f"{b}n") * OF >= F.greatest(f"{a}n", f"{b}n") * SHARE) & (bits <= F.when(F.least(f"{a}n", f"{b}n") < SMALL, FARTHEST).otherwise(FAR))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def links(prints: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``a, b``: links that connect what similar sets of ``prints`` (``sketches`` of ``docs``, stored) connect."""
    one = prints.where("n > 0").groupBy("fp").agg(F.min(F.struct("h", "n", *_PRINT, "anchors")).alias("x"))
    nodes = stored(one.select(F.col("fp").alias("node"), "x.*"))
    keyed = stored(_keyed(nodes))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1").select(F.col("key").alias("of"), "m", "pivot"))
    met = stored(keyed.join(shared, F.col("key") == F.col("of")).select("key", "node", "m", "pivot"))
    sized = stored(nodes.join(met.select(F.col("node").alias("mn")).distinct(), F.col("node") == F.col("mn"), "left_semi").select(F.col("node").alias("id"), "h", "n", *_PRINT))
    columns = ["key", "node", "n", *_PRINT]
    members = stored(met.join(sized, F.col("node") == F.col("id")).select(*columns, "m", "pivot"))

    few = members.where(F.col("m") <= PAIRED).select(*columns)
    within = few.join(_renamed(few, "o_"), (F.col("key") == F.col("o_key")) & (F.col("node") < F.col("o_node")) & _near("", "o_")).select(F.col("node").alias("a"), F.col("o_node").alias("b"))
    many = members.where(F.col("m") > PAIRED)
    spokes = stored(many.where("node != pivot").select("pivot", "node").distinct())
    ends = spokes.join(sized, F.col("node") == F.col("id")).select("pivot", "node", "n", *_PRINT)
    star = ends.join(_renamed(sized, "o_"), (F.col("pivot") == F.col("o_id")) & _near("", "o_")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = stored(within.unionByName(star).distinct())
    met_by = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct()
    hashed = lambda nodes: stored(nodes.join(sized, F.col("x") == F.col("id")).select(F.col("h").alias("w")))
    found = stored(verified(pairs, stored(_sets(docs, hashed(met_by), text))))
    if many.isEmpty():
        return found

    roots = components(found).select(F.col("node").alias("rn"), "root")
    rooted = stored(many.select("key", "node", "pivot").join(roots, F.col("node") == F.col("rn"), "left").select("key", "node", "pivot", F.coalesce("root", "node").alias("root")))
    head = F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("head")
    unsettled = stored(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), head).where("low != high").select(F.col("key").alias("of"), "head"))
    left = stored(rooted.join(unsettled, F.col("key") == F.col("of")).select("node", "root", "head").distinct())
    known = stored(roots.where("rn != root").select(F.col("root").alias("a"), F.col("rn").alias("b")))
    if left.isEmpty():
        return known
    between = stored(left.where("root != head").select(F.col("head").alias("a"), F.col("root").alias("b")).distinct())
    families = components(between).select(F.col("node").alias("fr"), F.col("root").alias("family"))
    own = stored(left.select("node", "root").distinct())
    sets = stored(_sets(docs, hashed(own.select(F.col("node").alias("x"))), text))
    relatives = stored(own.join(families, F.col("root") == F.col("fr")).select("family", "node", "root"))
    return known.unionByName(apart(relatives, sets))


def apart(relatives: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links that connect what similar sets of a family connect, for ``relatives(family, node, root)`` with the
    component so far, and ``sets(node, items)``; both stored. Exact.

    D is a set's symmetric difference to the items that more than half of the family has. Two sets are similar if their D
    have at least (debt + other debt) / (2 * (SHARE + OF)) items in common, a debt being (SHARE + OF) * |D| less (OF - SHARE)
    times the set's size. Where that is none, both are linked to the family's set of least debt, without a comparison. Other
    pairs share one of the first items of their D, rarest first, the more of them needed the fewer (prefix filtering).
    """
    sizes = stored(relatives.groupBy("family").agg(F.count("*").alias("members")).withColumnRenamed("family", "of"))
    whole = relatives.join(sizes, F.col("family") == F.col("of")).join(sets.select(F.col("node").alias("sn"), "items"), F.col("node") == F.col("sn"))
    full = stored(whole.select("family", "members", "node", "root", "items"))
    # counted and chosen before rows are dealt by family alone: what is left is less than two sets of the mean size
    times = full.select("family", "members", F.explode("items").alias("item")).groupBy("family", "members", "item").agg(F.count("*").alias("times"))
    usual = stored(times.where(2 * F.col("times") > F.col("members")).groupBy(F.col("family").alias("of")).agg(F.collect_list("item").alias("usual")))
    most = F.coalesce("usual", F.array().cast("array<long>"))
    odd = F.concat(F.array_except("items", most), F.array_except(most, "items"))
    told = full.join(usual, F.col("family") == F.col("of"), "left").select("family", "node", "root", F.size("items").alias("n"), odd.alias("odd"))
    told = stored(told.withColumn("debt", (SHARE + OF) * F.size("odd") - (OF - SHARE) * F.col("n")))

    best = stored(told.groupBy(F.col("family").alias("bf")).agg(F.min(F.struct("debt", "node")).alias("best")))
    near = (F.col("debt") + F.col("best.debt") <= 0) & (F.col("node") != F.col("best.node"))
    linked = stored(told.join(best, F.col("family") == F.col("bf")).where(near).select(F.col("best.node").alias("a"), F.col("node").alias("b")))
    # a component of which a set is linked to the family's best is one with it
    joint = told.groupBy(F.col("family").alias("jf"), F.col("root").alias("jr")).agg(F.min("debt").alias("least"))
    joint = joint.join(best, F.col("jf") == F.col("bf")).select("jf", "jr", F.col("best.debt").alias("lowest"), F.when(F.col("least") + F.col("best.debt") > 0, F.col("jr")).alias("label"))
    told = told.join(stored(joint), (F.col("family") == F.col("jf")) & (F.col("root") == F.col("jr"))).select("family", "node", "n", "debt", "lowest", "label", "odd")
    told = stored(told)

    differing = stored(told.select("family", "node", F.explode("odd").alias("item")))
    common = stored(differing.groupBy(F.col("family").alias("cf"), F.col("item").alias("ci")).agg(F.count("*").alias("times")).where("times > 1"))
    sorted_ = differing.join(common, (F.col("family") == F.col("cf")) & (F.col("item") == F.col("ci"))).groupBy(F.col("node").alias("on")).agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("order"))
    needed = lambda debts: F.greatest(F.lit(1), F.ceil(debts / (2 * (SHARE + OF)))).cast("int")
    ordered = told.drop("odd").join(stored(sorted_), F.col("node") == F.col("on")).withColumn("size", F.size("order"))
    prefix = F.slice("order", 1, F.greatest(F.lit(0), F.col("size") - needed(F.col("debt") + F.col("lowest")) + 1))
    firsts = stored(ordered.select("family", "node", "n", "debt", "label", "size", F.posexplode(prefix).alias("at", "x")).select("*", F.col("x.item").alias("item")).drop("x"))
    other = _renamed(firsts, "o_")
    both = needed(F.col("debt") + F.col("o_debt"))
    meets = (F.col("family") == F.col("o_family")) & (F.col("item") == F.col("o_item")) & (F.col("node") < F.col("o_node")) & ~F.col("label").eqNullSafe(F.col("o_label"))
    meets &= (F.col("debt") + F.col("o_debt") > 0) & (F.col("at") + both <= F.col("size")) & (F.col("o_at") + both <= F.col("o_size")) & (F.least("n", "o_n") * OF >= F.greatest("n", "o_n") * SHARE)
    pairs = stored(firsts.join(other, meets).select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct())
    return linked.unionByName(verified(pairs, sets))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, of one document a component of similar texts: the least id, then text hash.

    Texts without words (null ones too) are copies of each other. Rows without an id come last; of rows equal in id and
    text one stays. An empty table stays empty.
    """
    prints = stored(sketches(docs, doc_id, text))
    return keep_first(docs, prints, stored(components(stored(links(prints, docs, text)))), doc_id, text)
