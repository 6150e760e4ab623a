"""Joins, set operations, sampling and order within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def deduplicated(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``, which must be total; partial minima, not a window."""
    rest = [c for c in df.columns]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select("_first.*")


def left_lookup(df: DataFrame, right: DataFrame, key: str, order: list) -> DataFrame:
    """Left join with one row a key on the right."""
    return df.join(deduplicated(right, [key], order), key, "left")


def reindex(order: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Every key of ``order(ord, key)``, with nulls where ``df`` lacks it; ``ord`` carries the order."""
    return order.join(df, key, "left")


def pair_by_part(df: DataFrame, key: str, part: str, one: str, other: str, columns: list[str]) -> DataFrame:
    """A row a key with both parts: ``<column>_A`` and ``<column>_B``."""
    side = lambda value, end: df.where(F.col(part) == value).select(key, *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return side(one, "A").join(side(other, "B"), key)


def hamming(a: str, b: str) -> Column:
    """Differing places of two strings of one length."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + (F.substr(F.col(a), i, F.lit(1)) != F.substr(F.col(b), i, F.lit(1))).cast("int"))


#: Members of a group whose names are compared with as many others at once.
NAMES = 2_048


def hamming_pairs(df: DataFrame, ident: str, group: str, seq: str) -> DataFrame:
    """``a, b, h`` for a < b in a group: the differing places of their texts, as ``hamming`` counts them; null if one is null.

    All pairs are the result, so they are made: a group's members go in tiles of NAMES by the order of their ids, each pair of
    tiles is a row of its own, and a task compares a block of code points at once. A null group has no pairs.
    """
    from tarn.operators.ordered import row_numbers

    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(seq).alias("s")).where("id IS NOT NULL")
    numbered = row_numbers(rows, ["g", "id"], "at")
    first = numbered.groupBy(F.col("g").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    placed = numbered.join(first, F.col("g") == F.col("of")).withColumn("tile", F.floor((F.col("at") - F.col("first")) / NAMES)).withColumn("last", F.floor((F.col("n") - 1) / NAMES))
    tiles = placed.groupBy("g", "tile", "last").agg(F.sort_array(F.collect_list(F.struct("id", "s"))).alias("rows"))
    left = tiles.select("g", F.col("tile").alias("i"), F.explode(F.sequence("tile", "last")).alias("j"), F.col("rows").alias("x"))
    right = tiles.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))).alias("i"), F.col("tile").alias("j"), F.col("rows").alias("y"))
    met = left.join(right, ["g", "i", "j"]).select("x", "y")
    kind = to_arrow_type(df.schema[ident].dataType)

    def read(column: pa.Array, k: int) -> tuple:
        ids, texts = column[k].values.flatten()
        texts = ["" if t is None else t for t in texts.to_pylist()], texts.is_null().to_numpy(zero_copy_only=False)
        return ids.to_numpy(zero_copy_only=False), *texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ia, ta, na), (ib, tb, nb) = read(batch.column(0), k), read(batch.column(1), k)
                width = max(map(len, [*ta, *tb])) or 1
                a, b = (np.array(t, dtype=f"<U{width}").view(np.uint32).reshape(len(t), width) for t in (ta, tb))
                if max(a.max(), b.max()) < 256:
                    a, b = a.astype(np.uint8), b.astype(np.uint8)
                columns, length = np.ascontiguousarray(b.T), np.array([*map(len, ta)])
                step = max(1, (1 << 17) // len(ib))
                for at in range(0, len(ia), step):
                    own = slice(at, at + step)
                    h = np.zeros((len(ia[own]), len(ib)), np.int32)
                    for place in range(width):  # places behind the end of the first text don't count
                        h += (a[own, place, None] != columns[place]) & (length[own] > place)[:, None]
                    pair = np.nonzero(ia[own, None] < ib[None])
                    value = pa.array(h[pair].astype(np.int64), mask=na[own][pair[0]] | nb[pair[1]])
                    yield pa.RecordBatch.from_arrays([pa.array(ia[own][pair[0]], type=kind), pa.array(ib[pair[1]], type=kind), value], ["a", "b", "h"])

    name = df.schema[ident].dataType.simpleString()
    return met.mapInArrow(run, f"a {name}, b {name}, h long")


def one_apart(df: DataFrame, ident: str, blocks: list[str], seq: str) -> DataFrame:
    """``a, b`` of rows that share ``blocks`` and a sequence length and differ in one place.

    Each distinct sequence of a block gives one key a place: itself without that place's symbol. Sequences one apart share
    exactly one, so they meet by an equi-join; the rows join only what is one apart, however often a sequence is repeated.
    """
    rows = df.select(F.col(ident).alias("id"), *blocks, F.col(seq).alias("s"))
    holes = rows.select(*blocks, "s").where(F.length("s") > 0).distinct().select(*blocks, "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("at"))
    holes = holes.withColumn("hole", F.concat(F.expr("substring(s, 1, at - 1)"), F.lit("\0"), F.expr("substring(s, at + 1)")))
    near = holes.join(holes.withColumnRenamed("s", "s2"), [*blocks, "at", "hole"]).where(F.col("s") < F.col("s2")).select(*blocks, "s", "s2")
    one = near.join(rows.withColumnRenamed("id", "i"), [*blocks, "s"]).select(*blocks, "i", "s2")
    two = one.join(rows.select(*blocks, F.col("id").alias("j"), F.col("s").alias("s2")), [*blocks, "s2"])
    return two.where(F.col("i") != F.col("j")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def near_points(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``a, b, d`` of ``id, x, y, z`` points at most ``radius`` apart, by a grid of that width and its neighbour cells;
    with ``by``, only points of the same values there."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.array(cell(c) - 1, cell(c), cell(c) + 1)
    l_ = left.select(*by, F.col("id").alias("a"), *[F.col(c).alias(f"{c}1") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    r = right.select(*by, F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[near(c).alias(f"n{c}") for c in "xyz"])
    for c in "xyz":
        r = r.withColumn(f"c{c}", F.explode(f"n{c}"))
    d2 = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz")
    return l_.join(r, [*by, "cx", "cy", "cz"]).withColumn("d", F.sqrt(d2)).where(F.col("d") <= radius).select(*by, "a", "b", "d")


def best_match(pairs: DataFrame, key: str, candidate: str, equal: Column, least: int, accept: float) -> DataFrame:
    """The candidate of each key with the largest share of equal places over ``least`` places or more."""
    shares = pairs.groupBy(key, candidate).agg(F.avg(equal.cast("int")).alias("identity"), F.count("*").alias("shared")).where(F.col("shared") >= least)
    best = shares.groupBy(key).agg(F.min_by(F.struct(candidate, "identity", "shared"), F.struct(-F.col("identity"), F.col(candidate))).alias("x")).select(key, "x.*")
    return best.withColumn("accepted", F.col("identity") >= accept)


def nearest(pairs: DataFrame, key: str, d: str, tie: str) -> DataFrame:
    return deduplicated(pairs, [key], [F.col(d), F.col(tie)])


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key: an aggregate would hold whole groups, a window limit filters as it sorts."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``u``: a seeded total order that is the same on every engine: md5 of key and seed, then the key."""
    return df.withColumn("u", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))


def sample_sorted(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return shuffled(df, key, seed).orderBy("u", key).limit(n).drop("u")


def set_flags(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``only_left, only_right, both, same, subset`` of two key sets."""
    l_, r = (d.select(key).distinct().withColumn(n, F.lit(1)) for d, n in ((left, "_l"), (right, "_r")))
    joined = l_.join(r, key, "full")
    one = joined.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))
    return one.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0)).withColumn("subset", F.col("only_left") == 0)


def member_sets(df: DataFrame, cluster: str, member: str) -> DataFrame:
    """``members``: the sorted set as text; equal for equal clusters whatever their numbers."""
    return df.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"))
