"""Complete-linkage clusters at a cut, their numbering, and comparisons of partitions."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.ordered import row_numbers
from tarn.sources.storage import materialize

#: Members of a connected component that one task agglomerates in a dense matrix, 128 MB of them; larger ones are merged in rounds.
LARGEST = 4_000


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` over ``edges(a, b)``: neighbours merge by the round's hash order until no edge is left."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    left, steps = materialize(both), []
    while not left.isEmpty():
        turn = len(steps)
        key = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("id"))
        step = materialize(left.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least(key("a"), "m")["id"].alias("to")))
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        left = materialize(left.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a != b").distinct())
        steps.append(step)
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:  # where a node's root went on in a later round
        roots = roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(roots)


def agglomerate(d: np.ndarray, cut: float) -> np.ndarray:
    """Labels by complete linkage of a dense distance matrix, merged while the least linkage is at most ``cut``.

    Each round merges the closest pair, lower numbers first among equals; a cluster's distance to another is the larger one.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    near = d.argmin(1)
    least = d[np.arange(n), near]
    while alive.sum() > 1:
        i = int(np.where(alive, least, np.inf).argmin())
        if not least[i] <= cut:
            break
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        far = np.maximum(d[i], d[j])
        far[[i, j]] = np.inf
        d[i], d[:, i] = far, far
        d[j], d[:, j] = np.inf, np.inf
        alive[j], least[j] = False, np.inf
        label[label == j] = i
        stale = np.nonzero(alive & ((near == i) | (near == j)))[0]
        for k in {i, *stale.tolist()}:
            near[k] = int(d[k].argmin())
            least[k] = d[k, near[k]]
        closer = alive & (d[i] < least)
        near[closer], least[closer] = i, d[i][closer]
    return label


def complete_linkage(nodes: DataFrame, pairs: DataFrame, ident: str, cut: float) -> DataFrame:
    """``<ident>, cluster``: numbers from 0 by falling size, then least member; -1 for singletons.

    Pairs farther apart than the cut can't share a cluster, so the connected components of the nearer pairs are
    clustered apart: those of LARGEST members at most in one task each, the others by ``merged_in_rounds``. Distances that
    tie between three clusters or more may merge in another order there.
    """
    close = materialize(pairs.where(F.col("d") <= cut).select("a", "b", "d"))
    roots = connected(close)
    marked = close.join(roots.select(F.col("node").alias("a"), "root"), "a")
    sizes = materialize(roots.groupBy("root").agg(F.count("*").alias("members")))
    few = marked.join(sizes.where(F.col("members") <= LARGEST), "root", "left_semi")
    many = marked.join(sizes.where(F.col("members") > LARGEST), "root", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        d = np.full((len(ids), len(ids)), np.inf)
        i, j = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
        d[i, j] = d[j, i] = pdf["d"]
        return pd.DataFrame({"id": ids, "raw": ids[agglomerate(d, cut)]})

    kind = dict(nodes.dtypes)[ident]
    raw = few.groupBy("root").applyInPandas(run, f"id {kind}, raw {kind}").unionByName(merged_in_rounds(many.select("a", "b", "d")))
    whole = nodes.select(F.col(ident).alias("id")).join(raw, "id", "left").select("id", F.coalesce("raw", "id").alias("raw"))
    numbers = relabel_by_size(whole, "raw", "id")
    return whole.join(numbers, "raw").select(F.col("id").alias(ident), "cluster")


#: Edges between clusters that one task merges to the end, some 100 MB of them; while there are more, they are merged in rounds.
FEW = 500_000


def merged_in_rounds(close: DataFrame, few: int | None = None) -> DataFrame:
    """``id, raw``: complete linkage of the pairs ``a, b, d`` that are within the cut, in rounds over tables of edges.

    Two clusters can merge if all their cross pairs are there; the largest is their linkage. What lacks a cross pair lacks it
    for good, so only edges between clusters with all of theirs are kept, and they soon are few. Each round merges all pairs
    of clusters that are each other's nearest: merging others never brings a cluster nearer, so the result is that of
    merging the closest pair first. A round is a few grouped passes over the edges, and the closest pair of all merges in
    each. The last ``few`` edges (FEW) are merged in one task.
    """
    few = FEW if few is None else few
    edges = materialize(close.select(F.col("a").alias("x"), F.col("b").alias("y"), "d"))
    member = materialize(close.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("raw", F.col("id")))
    while (left := edges.count()) > few:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
        lower, upper = F.least("x", "y"), F.greatest("x", "y")
        near = both.groupBy("x").agg(F.min(F.struct("d", lower.alias("l"), upper.alias("u"), "y")).alias("m")).select(F.col("x").alias("c"), F.col("m.y").alias("to"))
        near = materialize(near)
        back = near.select(F.col("c").alias("to"), F.col("to").alias("c"))
        moves = materialize(near.join(back, ["c", "to"]).where("to < c"))
        member = materialize(_moved(member, moves))
        edges = materialize(_cross(edges, moves))
    if left:
        kind = dict(edges.dtypes)["x"]
        last = edges.groupBy(F.lit(0).alias("all")).applyInPandas(_merged, f"c {kind}, to {kind}")
        member = _moved(member, materialize(last))
    return member


def _moved(member: DataFrame, moves: DataFrame) -> DataFrame:
    """``id, raw`` where the clusters that moved have their new name."""
    return member.join(moves.select(F.col("c").alias("raw"), "to"), "raw", "left").select("id", F.coalesce("to", "raw").alias("raw"))


def _merged(edges: pd.DataFrame) -> pd.DataFrame:
    """``c, to``: where each cluster of ``edges(x, y, d)`` ends, if not in itself, merging the closest pair first."""
    near: dict = {}
    for x, y, d in zip(edges["x"].tolist(), edges["y"].tolist(), edges["d"].tolist(), strict=True):
        near.setdefault(x, {})[y] = d
        near.setdefault(y, {})[x] = d
    heap = [(d, min(x, y), max(x, y)) for x, y, d in zip(edges["x"].tolist(), edges["y"].tolist(), edges["d"].tolist(), strict=True)]
    heapq.heapify(heap)
    into: dict = {}
    while heap:
        d, x, y = heapq.heappop(heap)
        if near.get(x, {}).get(y) != d:
            continue
        one, other = near.pop(x), near.pop(y)
        into[y] = x
        for z in one.keys() | other.keys():
            if z not in (x, y):
                near[z].pop(x, None), near[z].pop(y, None)
        near[x] = {z: max(one[z], other[z]) for z in one.keys() & other.keys()}
        for z, far in near[x].items():
            near[z][x] = far
            heapq.heappush(heap, (far, min(x, z), max(x, z)))

    def end(c):
        while c in into:
            c = into[c]
        return c

    return pd.DataFrame({"c": list(into), "to": [end(c) for c in into]})


def _cross(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``x, y, d``: the edges between the clusters after ``moves`` that have all their cross pairs, with the largest distance."""
    ends = moves.select("c", "to").unionByName(moves.select(F.col("to").alias("c"), "to"))
    go = lambda c: F.coalesce(F.col(f"to_{c}"), F.col(c))
    met = edges.join(ends.select(F.col("c").alias("x"), F.col("to").alias("to_x")), "x", "left").join(ends.select(F.col("c").alias("y"), F.col("to").alias("to_y")), "y", "left")
    parts = F.when(F.col("to_x").isNull(), 1).otherwise(2) * F.when(F.col("to_y").isNull(), 1).otherwise(2)  # a move joins two
    between = met.select(go("x").alias("x"), go("y").alias("y"), "d", parts.alias("parts")).where("x != y")
    grouped = between.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("parts").alias("parts"))
    return grouped.where("n = parts").select("x", "y", "d")


def relabel_by_size(df: DataFrame, label: str, member: str) -> DataFrame:
    """``<label>, cluster``: 0 for the largest, ties by least member; -1 for labels of one member."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"), F.min(member).alias("_first"))
    numbered = row_numbers(sizes, [F.desc("_n"), F.col("_first")], "_k")
    return numbered.select(label, F.when(F.col("_n") == 1, F.lit(-1).cast("long")).otherwise(F.col("_k")).alias("cluster"))


def adjusted_rand(df: DataFrame, one: str, other: str) -> DataFrame:
    """``ari`` of two label columns; -1 means a singleton, so such rows are told apart by ``_id``, a column that must be there."""
    own = lambda c: F.when(F.col(c) == -1, F.concat(F.lit("s"), F.col("_id").cast("string"))).otherwise(F.col(c).cast("string"))
    cells = df.groupBy(own(one).alias("x"), own(other).alias("y")).agg(F.count("*").alias("n"))
    two = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    rows = cells.groupBy("x").agg(F.sum("n").alias("a")).agg(two("a").alias("sa"), F.sum("a").alias("n"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("b")).agg(two("b").alias("sb"))
    both = cells.agg(two("n").alias("sc")).crossJoin(rows).crossJoin(cols)
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    return both.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("sc") - expected) / (most - expected)).alias("ari"))


def inside(pairs: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """The pairs whose members share a cluster, with its number."""
    a = labels.where("cluster >= 0").select(F.col(ident).alias("a"), F.col("cluster").alias("ca"))
    b = labels.where("cluster >= 0").select(F.col(ident).alias("b"), F.col("cluster").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", "d", F.col("ca").alias("cluster"))
