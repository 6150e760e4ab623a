"""Operator 11, hard-negative mining: dual-tree search over anchors and candidates.

A tree of planes, fitted on a bounded sample, gives every row a leaf; the rows are written by leaf, so that what a task
reads lies together. Anchors go in groups of bounded size, in leaf order; each group's ball tree is sent to all tasks. A task
builds ball trees over what it reads and walks both trees at once: a pair of nodes whose interval of inner products can't
enter any of its anchors' lists is left out whole, and pairs of leaves are scored exactly. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import discard, hash_sample, stored, table
from tarn.operators.ordered import row_numbers

#: Rows that the planes are fitted on and first lower bounds come from, about.
SAMPLE = 4_096
#: Anchors that are searched at a time, and that are sent to all tasks.
GROUP = 16_384
#: Rows in a leaf of the candidates' trees and of the anchors'.
LEAF, ANCHOR_LEAF = 128, 32
#: Hits that are held before they are merged into the lists.
HELD = 20_000
#: Levels of the tree of planes.
LEVELS = 7
#: Doubles hold scores below this exactly; rows that could pass it raise.
LARGEST = 1 << 53
NONE, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Balls:
    """A ball tree over rows: each node has a range of the reordered rows, a centre, a radius and its label if it has one only."""

    def __init__(self, v: np.ndarray, labels: np.ndarray, leaf: int):
        self.leaf, self.rows, self.nodes = leaf, np.arange(len(v)), []
        self._add(v, labels, 0, len(v))

    def _add(self, v: np.ndarray, labels: np.ndarray, low: int, high: int) -> int:
        rows = self.rows[low:high]
        own = v[rows].astype(float)
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        kinds = np.unique(labels[rows])
        at = len(self.nodes)
        node = [low, high, centre, float(np.sqrt(away.max())) * (1 + 1e-9), float(np.sqrt(centre @ centre)), kinds[0] if len(kinds) == 1 else None, []]
        self.nodes.append(node)
        if high - low > self.leaf:
            far = own[away.argmax()]
            along = own @ (own[((own - far) ** 2).sum(1).argmax()] - far)
            half = (high - low) // 2
            self.rows[low:high] = rows[np.argpartition(along, half)]
            node[6] = [self._add(v, labels, a, b) for a, b in ((low, low + half), (low + half, high))]
        return at


def interval(a: list, b: list) -> tuple[float, float]:
    """Least and greatest inner product of a row in ball ``a`` with one in ball ``b``; the slack is for rounding."""
    middle, spread = float(a[2] @ b[2]), a[4] * b[3] + b[4] * a[3] + a[3] * b[3]
    slack = 1e-9 * (a[4] + a[3]) * (b[4] + b[3])
    return middle - spread - slack, middle + spread + slack


class Lists:
    """The best ``k`` (score, id) of each of ``n`` queries, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.scores, self.ids = k, np.full((n, k), LOWEST), np.full((n, k), NONE)
        self.least, self.last = floor.copy(), np.full(n, NONE)  # what a hit must reach, and must precede on a tie
        self.held, self.size = [], 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((query, score, ids))
        self.size += len(query)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        query, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        asked = np.unique(query)
        old = self.scores[asked] != LOWEST
        query = np.concatenate([query, np.repeat(asked, old.sum(1))])
        score, ids = np.concatenate([score, self.scores[asked][old]]), np.concatenate([ids, self.ids[asked][old]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        query, place = query[best], place[best]
        self.scores[query, place], self.ids[query, place] = score[best], ids[best]
        full = asked[self.scores[asked, -1] != LOWEST]
        self.least[full], self.last[full] = self.scores[full, -1], self.ids[full, -1]


class Search:
    """One group's anchors, their tree, and what is asked of them: ``each`` queries an anchor, with a floor and a ceiling."""

    def __init__(self, v: np.ndarray, uid: np.ndarray, labels: np.ndarray, each: int, k: int, floor: np.ndarray, ceiling: np.ndarray, same: bool):
        self.tree, self.each, self.k, self.same = Balls(v, labels, ANCHOR_LEAF), each, k, same
        self.v, self.uid, self.labels, self.floor, self.ceiling = v, uid, labels, floor, ceiling
        self.norms = np.sqrt((v.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        # The greatest ceiling below each node stays; the least floor rises as lists fill.
        self.tops = [ceiling[self._queries(n)].max() for n in self.tree.nodes]

    def _queries(self, node: list) -> np.ndarray:
        return (self.tree.rows[node[0] : node[1], None] * self.each + np.arange(self.each)).ravel()

    def scan(self, lists: Lists, v: np.ndarray, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> int:
        """Enters the rows that belong into ``lists``; returns how many pairs of rows were scored."""
        there, scored = Balls(v, labels, LEAF), 0
        anchors, rows = self.v.astype(float), v.astype(float)
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            a, b = self.tree.nodes[i], there.nodes[j]
            if a[5] is not None and b[5] is not None and (a[5] == b[5]) != self.same:
                continue
            low, high = interval(a, b)
            asked = self._queries(a)
            if high < lists.least[asked].min() or low > self.tops[i]:
                continue
            if a[6] and (not b[6] or a[3] >= b[3]):
                todo += [(x, j) for x in a[6]]
            elif b[6]:
                todo += [(i, x) for x in sorted(b[6], key=lambda x: float(a[2] @ there.nodes[x][2]))]  # the best is taken first
            else:
                mine, theirs = self.tree.rows[a[0] : a[1]], there.rows[b[0] : b[1]]
                reach = anchors[mine] @ b[2] + self.norms[mine] * b[3] * (1 + 1e-9) + 1e-9 * self.norms[mine] * b[4]
                mine = mine[reach >= lists.least[asked].reshape(-1, self.each).min(1)]  # single anchors against the ball
                if not len(mine):
                    continue
                score = (anchors[mine] @ rows[theirs].T).astype(np.int64)
                scored += score.size
                fits = ((self.labels[mine][:, None] == labels[theirs][None]) == self.same) & (self.uid[mine][:, None] != uid[theirs][None])
                for e in range(self.each):
                    q = mine * self.each + e
                    least = lists.least[q][:, None]
                    hit = fits & (score <= self.ceiling[q][:, None]) & ((score > least) | ((score == least) & (ids[theirs][None] < lists.last[q][:, None])))
                    at, of = np.nonzero(hit)
                    if len(at):
                        lists.add(q[at], score[at, of], ids[theirs][of])
        return scored

    def found(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """``query, id, score``: the best of what one task reads, at most ``k`` rows a query."""
        lists = Lists(len(self.floor), self.k, self.floor)
        for b in batches:
            if len(b):
                self.scan(lists, np.stack(b["v"]).astype(np.int64), b["uid"].to_numpy(), b["id"].to_numpy(), b["label"].to_numpy())
                lists.merge()
        query, place = np.nonzero(lists.scores != LOWEST)
        yield pd.DataFrame({"query": query, "id": lists.ids[query, place], "score": lists.scores[query, place]})


def planes(v: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Splits at the median along the line between two far rows, level by level: node i has the children 2 i + 1 and 2 i + 2."""
    parts, out = [v], []
    for i in range((1 << LEVELS) - 1):
        own = parts[i]
        if len(own) < 2:
            out.append((np.zeros(v.shape[1]), 0.0))
            parts += [own, own]
            continue
        first = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        normal = own[((own - first) ** 2).sum(1).argmax()] - first
        along = own @ normal
        cut = float(np.median(along))
        out.append((normal, cut))
        parts += [own[along < cut], own[along >= cut]]
    return out


def leaves(v: np.ndarray, tree: list[tuple[np.ndarray, float]]) -> np.ndarray:
    node = np.zeros(len(v), int)
    for _ in range(LEVELS):
        side = np.empty(len(v), int)
        for n in np.unique(node):
            at = node == n
            side[at] = v[at] @ tree[n][0] >= tree[n][1]
        node = 2 * node + 1 + side
    return node - ((1 << LEVELS) - 1)


def _taking_part(rows: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """``uid, id, label, anchor, v`` of the rows that take part, written."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    some = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    sizes = some.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    wide = F.exists(x, lambda c: F.abs(c.cast("double") * scale) + 1 >= F.sqrt(F.lit(float(LARGEST)) / F.size(x)))
    whole = F.when(wide, F.raise_error(F.lit(f"inner products beyond {LARGEST}"))).otherwise(whole)
    some = some.where(F.size(x) == (sizes[0]["d"] if sizes else 0))
    return stored(some.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v")))


def _by_leaf(rows: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The rows written in leaf order, with ``leaf`` and ``away`` from the leaf's centre, and the sample."""
    sample = hash_sample(rows, "uid", SAMPLE).select("uid", "id", "label", "v").orderBy("uid").toPandas()
    v = np.stack(sample["v"]).astype(float) if len(sample) else np.zeros((1, 0))
    tree = planes(v)
    of = leaves(v, tree)
    centres = {n: v[of == n].mean(0) for n in np.unique(of)}
    nowhere = np.zeros(v.shape[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own = np.stack(b["v"]).astype(float)
                leaf = leaves(own, tree)
                away = np.sqrt(((own - np.stack([centres.get(n, nowhere) for n in leaf])) ** 2).sum(1))
                yield b.assign(leaf=leaf, away=away)

    placed = rows.mapInPandas(run, "uid long, id long, label long, anchor boolean, v array<long>, leaf int, away double")
    sample.attrs["centres"] = [(int(n), centres.get(n, nowhere)) for n in range(1 << LEVELS)]
    return stored(placed.repartitionByRange("leaf", "away", "uid").sortWithinPartitions("leaf", "away", "uid")), sample


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query over all tasks, with ``place`` from 1; a task sends ``k`` rows a query at most."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _read(rows: DataFrame, radii: dict[int, float], centres: list, search: Search) -> DataFrame:
    """The leaves that some anchor may need: the walk of the anchors' tree against each leaf's ball."""
    needed = []
    for n, c in centres:
        if n not in radii:
            continue
        ball, todo = [0, 0, c, radii[n] * (1 + 1e-9), float(np.sqrt(c @ c))], [0]
        while todo:
            a = search.tree.nodes[i := todo.pop()]
            low, high = interval(a, ball)
            if high < search.floor[search._queries(a)].min() or low > search.tops[i]:
                continue
            if not a[6]:
                needed.append(n)
                break
            todo += a[6]
    return rows.where(F.col("leaf").isin(needed)) if needed else rows.limit(0)


def _floors(v: np.ndarray, uid: np.ndarray, labels: np.ndarray, sample: pd.DataFrame, each: int, k: int, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> np.ndarray:
    """``floor`` raised to the ``k``-th best score among the sample's rows, where it has as many: rows that take part, so a true bound."""
    there, kinds, uids = np.stack(sample["v"]).astype(float), sample["label"].to_numpy(), sample["uid"].to_numpy()
    out = floor.copy()
    for low in range(0, len(v), 512):
        own = slice(low, low + 512)
        score = (v[own].astype(float) @ there.T).astype(np.int64)
        fits = ((labels[own][:, None] == kinds[None]) == same) & (uid[own][:, None] != uids[None])
        for e in range(each):
            q = np.arange(low, low + len(score)) * each + e
            inside = np.where(fits & (score <= ceiling[q][:, None]), score, LOWEST)
            if inside.shape[1] >= k:
                out[q] = np.maximum(out[q], np.partition(inside, -k, axis=1)[:, -k])
    return out


def mine(
    rows: DataFrame, label: Column, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(scale * x). An anchor's positives are the first ``positives`` other rows of its
    label, its negatives for each the first ``negatives`` of the other labels with low * positive <= 100 * negative <=
    high * positive; higher scores come first, then smaller ids, and fewer are returned where there are no more.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; neither do vectors of another
    length than the commonest (of equally common the longer). Repeated rows are rows of their own: a copy of an anchor
    can be its positive, and a repeated anchor has its results twice. An empty table gives an empty result, other columns
    are ignored. Scores that could pass 2^53 raise. Positives reach the driver a group of anchors at a time.
    """
    parts = _taking_part(rows, vec_id, vector, label, anchor, scale)
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    placed, sample = _by_leaf(parts)
    if not len(sample):
        return spark.createDataFrame([], schema)
    radii = {r["leaf"]: r["r"] for r in placed.groupBy("leaf").agg(F.max("away").alias("r")).collect()}  # a row a leaf
    centres = sample.attrs["centres"]
    numbered = stored(row_numbers(placed.where("anchor").select("leaf", "away", "uid", "id", "label", "v"), ["leaf", "away", "uid"], "place"))
    out = []
    for first in range(0, numbered.count(), GROUP):
        own = numbered.where(F.col("place").between(first, first + GROUP - 1)).orderBy("place").select("uid", "id", "label", "v").toPandas()
        v, uid, labels, n = np.stack(own["v"]).astype(np.int64), own["uid"].to_numpy(), own["label"].to_numpy(), len(own)
        open_, free = np.full(n, NONE), np.full(n, LOWEST + 1)
        search = Search(v, uid, labels, 1, positives, _floors(v, uid, labels, sample, 1, positives, free, open_, True), open_, True)
        best = _best(_read(placed, radii, centres, search).select("uid", "id", "label", "v").mapInPandas(search.found, "query long, id long, score long"), positives).toPandas()
        score, of = np.full((n, positives), LOWEST), np.zeros((n, positives), np.int64)
        score[best["query"], best["place"] - 1], of[best["query"], best["place"] - 1] = best["score"], best["id"]
        there = score >= 0  # below nought no score lies in the window
        floor = np.where(there, -((-low * np.where(there, score, 0)) // 100), NONE - 1).ravel()
        ceiling = np.where(there, high * np.where(there, score, 0) // 100, LOWEST).ravel()
        search = Search(v, uid, labels, positives, negatives, _floors(v, uid, labels, sample, positives, negatives, floor, ceiling, False), ceiling, False)
        found = stored(_best(_read(placed, radii, centres, search).select("uid", "id", "label", "v").mapInPandas(search.found, "query long, id long, score long"), negatives))
        asked = pd.DataFrame({"query": np.arange(n * positives), "anchor_id": np.repeat(own["id"].to_numpy(), positives), "positive_id": of.ravel(), "positive_score": score.ravel()})[there.ravel()]
        out.append(found.join(spark.createDataFrame(asked, "query long, anchor_id long, positive_id long, positive_score long"), "query"))
    discard(parts)
    if not out:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


SQL = """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS row_no, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.row_no <> b.row_no WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT row_no, anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY row_no ORDER BY score DESC, other_id) AS nth
  FROM scored WHERE same QUALIFY nth <= 5),
pairs AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.row_no, p.nth ORDER BY s.score DESC, s.other_id) AS place
  FROM positives p JOIN scored s USING (row_no)
  WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM pairs WHERE place <= 10
"""
