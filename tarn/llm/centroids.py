"""Operator 13, centroid clustering: k-means rounds over integer vectors, assigned by exponion search.

Every row carries its centroid and two bounds in a written table: an upper one on the distance to its centroid, a lower
one on the distance to every other. A row is scanned only when the bounds don't settle it, and then only over centroids in
a ball around its own, by that centroid's sorted list of the others. Distances and sums are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import discard, stored, table

#: Components beyond this could make a squared distance overflow a long, so they raise.
WIDEST = 1 << 27
#: Bounds are doubles; they are moved apart by this share, far more than their rounding errors.
SLACK = 1e-9
_STATE = "id long, v binary, cluster int, upper double, lower double, distance long, n long, sums array<long>"


def kept_vectors(rows: DataFrame, vec_id: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """``id, v``: floor(scale * x) of the vectors with ``dimension`` components, none null or non-finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    wide = F.exists(whole, lambda c: F.abs(c) > WIDEST)
    return rows.where(x.isNotNull() & (F.size(x) == dimension) & finite).select(
        F.col(vec_id).cast("long").alias("id"), F.when(wide, F.raise_error(F.lit(f"a component is beyond {WIDEST}"))).otherwise(whole).alias("v")
    )


def exponion(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) and its new bounds.

    ``upper`` and ``lower`` must bound the distances to ``own`` and to all others. With r the distance to the own centroid
    and s from it to its nearest other, both the nearest and the second nearest lie within 2 r + s of the own centroid: the
    other at s is within r + s of the row. The ball includes its border, so equally near centroids are compared.
    """
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2).astype(float))
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1, kind="stable")
    lists = np.take_along_axis(apart, order, 1)
    gap = lists[:, 0]  # infinite for a single centroid
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    settled = np.maximum(lower, gap[own] / 2) * (1 - SLACK)
    open_ = np.flatnonzero(~(upper < settled))
    near = ((v[open_] - centres[own[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(near.astype(float)) * (1 + SLACK)
    still = ~(upper[open_] < settled[open_])
    open_, near = open_[still], near[still]
    before = own[open_]
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        at, best = open_[rows], near[rows]
        number, second = np.full(len(at), a), np.full(len(at), np.iinfo(np.int64).max)
        reach = np.searchsorted(lists[a, :-1], (2 * upper[at] + gap[a]) * (1 + SLACK), side="right")
        for t in range(reach.max(initial=0)):
            s = np.flatnonzero(reach > t)
            j = order[a, t]
            d = ((v[at[s]] - centres[j]) ** 2).sum(1)
            wins = (d < best[s]) | ((d == best[s]) & (j < number[s]))
            second[s] = np.minimum(second[s], np.where(wins, best[s], d))
            best[s], number[s] = np.where(wins, d, best[s]), np.where(wins, j, number[s])
        own[at] = number
        upper[at], lower[at] = np.sqrt(best.astype(float)) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)
    return own, upper, lower


def _assigned(state: DataFrame, centres: np.ndarray, moved: np.ndarray, dimension: int, last: bool) -> DataFrame:
    """``state`` after one assignment. A task adds a row for each of its centroids with the count and sums of its vectors."""
    k = len(centres)
    others = np.array([np.delete(moved, a).max(initial=0.0) for a in range(k)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not len(b):
                continue
            v = np.frombuffer(b"".join(b["v"]), np.int32).reshape(len(b), dimension).astype(np.int64)
            own = b["cluster"].to_numpy(np.int64)
            own, upper, lower = exponion(v, own, (b["upper"].to_numpy() + moved[own]) * (1 + SLACK), np.maximum(b["lower"].to_numpy() - others[own], 0) * (1 - SLACK), centres)
            np.add.at(sums, own, v)
            n += np.bincount(own, minlength=k)
            exact = ((v - centres[own]) ** 2).sum(1) if last else None
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cluster": own, "upper": upper, "lower": lower, "distance": exact, "n": None, "sums": None})
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"id": None, "v": None, "cluster": some, "upper": None, "lower": None, "distance": None, "n": n[some], "sums": list(sums[some])})

    return stored(state.where("v is not null").mapInPandas(run, _STATE))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        whole = [np.asarray(x, np.int32).tobytes() for x in b["v"]]
        yield pd.DataFrame({"id": b["id"], "v": whole, "cluster": 0, "upper": np.inf, "lower": 0.0, "distance": None, "n": None, "sums": None})


def cluster(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of salt and id (fewer, if fewer are kept; repeated
    ids by their vectors; rows without an id last). Each round assigns all vectors and replaces every centroid that has
    any by the floor of their mean; then all are assigned once more. Equal vectors, ids and centroids are as good as
    others: repeated rows stay repeated, and an empty centroid stays where it is. An empty table gives an empty result;
    other columns are ignored. Components beyond 2^27 raise, as squared distances would not fit a long. What reaches the
    driver are k centroids and their sums, whatever the number of rows.
    """
    kept = kept_vectors(rows, vec_id, vector, dimension, scale)
    # Nulls sort first, so a digest of no id becomes a string behind all hex digits.
    starts = kept.select(F.coalesce(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), F.lit("~")).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centres = np.array([r["v"] for r in starts], np.int64).reshape(-1, dimension)
    spark, schema = rows.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], schema)
    state, moved = kept.mapInPandas(_packed, _STATE), np.zeros(len(centres))
    for i in range(rounds + 1):
        old, state = state, _assigned(state, centres, moved, dimension, i == rounds)
        if i:
            discard(old)
        if i < rounds:
            summed = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            new = centres.copy()
            for r in summed.collect():
                new[r["cluster"], r["at"]] = r["s"] // r["n"]
            moved, centres = np.sqrt(((new - centres) ** 2).sum(1).astype(float)), new
    digests = [(j, ",".join(map(str, c.tolist()))) for j, c in enumerate(centres)]
    named = spark.createDataFrame(digests, "j int, centroid string").select("j", F.sha2("centroid", 256).alias("centroid_sha256"))
    vectors = state.where("v is not null").select(F.col("id").alias("vec_id"), "cluster", "distance")
    sums = vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumnRenamed("cluster", "j")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    each = F.broadcast(sums.join(named, "j").crossJoin(total))  # k rows at most
    return vectors.join(each, F.col("cluster") == F.col("j")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_ASSIGN = """
d{i} AS (
  SELECT row_no, j, list_sum(list_transform(range(1, 65), lambda p: (v[p] - c[p]) * (v[p] - c[p])))::BIGINT AS d FROM kept, c{i}),
a{i} AS (SELECT row_no, (min_by(j, (d, j))) AS j, min(d) AS d FROM d{i} GROUP BY row_no),
"""
_MOVE = """
e{i} AS (SELECT a.j, unnest(range(1, 65)) AS p, unnest(v) AS x FROM a{i} a JOIN kept USING (row_no)),
m{i} AS (SELECT j, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS x FROM e{i} GROUP BY j, p),
l{i} AS (SELECT j, list(x ORDER BY p) AS c FROM m{i} GROUP BY j),
c{n} AS (SELECT j, coalesce(l{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN l{i} USING (j)),
"""
SQL = (
    """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept
  ORDER BY sha256('1:' || vec_id), v LIMIT 16),
"""
    + "".join(_ASSIGN.format(i=i) + _MOVE.format(i=i, n=i + 1) for i in range(3))
    + _ASSIGN.format(i=3)
    + """
inertias AS (SELECT j, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY j)
SELECT vec_id, a3.j::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a3) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (row_no) JOIN inertias USING (j) JOIN c3 USING (j)
"""
)
