"""Label tests on clusters: purity, stratified nulls, binomial enrichment, matches between partitions, pair draws."""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.digest import md5_high
from tarn.operators.ordered import benjamini_hochberg, row_numbers
from tarn.sources.storage import materialize


def dealt_anew(df: DataFrame, ident: str, strata: list[str], label: str, seed: Column | str) -> DataFrame:
    """``df`` with ``_dealt``: the label that the row gets when the labels of its stratum are dealt by md5 of id and seed.

    Both orders, by stratum and id and by stratum and digest, number a stratum's rows with the same range, so one join on
    the number deals all strata, and a stratum of any size is spread over many tasks.
    """
    u = F.md5(F.concat(F.col(ident).cast("string"), F.lit("|"), seed if isinstance(seed, Column) else F.lit(seed)))
    rows = row_numbers(df, [*strata, ident], "_at")
    given = row_numbers(df.select(*strata, ident, u.alias("_u"), F.col(label).alias("_dealt")), [*strata, "_u", ident], "_at").select("_at", "_dealt")
    return rows.join(given, "_at").drop("_at")


def stratum_shuffle(df: DataFrame, ident: str, strata: list[str], label: str, seed: str) -> DataFrame:
    """``df`` with the labels dealt anew within each stratum."""
    return dealt_anew(df, ident, strata, label, seed).withColumn(label, F.col("_dealt")).drop("_dealt")


def purity(df: DataFrame, cluster: str, label: str, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """``purity``: over clusters of ``least`` labelled members or more, the mean of the largest label's share, unweighted."""
    by = by or []
    counts = df.where(F.col(label).isNotNull() & (F.col(cluster) >= 0)).groupBy(*by, cluster, label).agg(F.count("*").alias("n"))
    shares = counts.groupBy(*by, cluster).agg(F.max("n").alias("top"), F.sum("n").alias("all")).where(F.col("all") >= least)
    share = F.avg(F.col("top") / F.col("all")).alias("purity")
    return shares.groupBy(*by).agg(share) if by else shares.agg(share)


#: Rows of a table whose replicates are dealt in a task each, some 400 MB of arrays at the most; larger tables' replicates are
#: spread over many tasks.
PACKED = 6_000_000
#: Rows of all rungs and replicates that are dealt in one pass, in a task a replicate and spread; rows of a stratum that are put in
#: order together where they are spread, about.
AT_ONCE, SPREAD_AT_ONCE, RUN = 2_000_000_000, 60_000_000, 10_000


def _ladder(rows: DataFrame, ident: str, cluster: str, label: str, rungs: dict[str, list[str]]) -> DataFrame:
    """``rung, at, first, size, <ident>, <cluster>, <label>``: for each rung the rows' places in the order of stratum and id, and where
    their stratum begins and how many rows it has. That doesn't depend on the draws."""
    out = None
    for k, strata in enumerate(rungs.values()):
        placed = materialize(row_numbers(rows, [*strata, ident], "at"), "placed")
        ends = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in strata]).agg(F.min("at").alias("first"), F.count("*").alias("size"))
        same = F.lit(True)
        for c in strata:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        joined = placed.join(ends, same) if strata else placed.crossJoin(F.broadcast(ends))
        one = joined.select(F.lit(k).alias("rung"), "at", "first", "size", ident, cluster, label)
        out = one if out is None else out.unionByName(one)
    return materialize(out, "ladder")


def _coded(df: DataFrame, column: str, name: str, kept: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the number from 0 of ``column``'s value among its distinct ones; -1 where it isn't ``kept``."""
    values = df.select(F.col(column).alias("_v")).where(F.col(column).isNotNull() if kept is None else kept).distinct()
    codes = materialize(row_numbers(values, ["_v"], name), "codes")
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("int"))


_PIECE = ["at", "first", "_cluster", "_label"]


def _pieces(base: DataFrame, ident: str) -> DataFrame:
    """``rung`` and, in a row for each batch of ``base``, its columns as bytes: places, starts of strata, codes, and the ids' texts
    with their lengths."""
    start = F.coalesce(F.concat(F.col(ident).cast("string"), F.lit("|")), F.lit(""))
    flat = base.select("rung", *[F.col(c).cast("int").alias(c) for c in _PIECE], F.encode(start, "utf-8").alias("text"))
    schema = pa.schema([("rung", pa.int32()), *[(c, pa.binary()) for c in [*_PIECE, "length", "text"]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rung in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), rung))
                cells = [own.column(k).to_numpy().astype(np.int32).tobytes() for k in range(1, 5)]
                text = own.column(5)
                lengths = pc.binary_length(text).to_numpy().astype(np.int32).tobytes()
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(text)], text), b"")
                yield pa.RecordBatch.from_arrays([pa.array([rung], pa.int32()), *[pa.array([c], pa.binary()) for c in [*cells, lengths, joined[0].as_py()]]], schema=schema)

    return flat.mapInArrow(run, "rung int, " + ", ".join(f"{c} binary" for c in [*_PIECE, "length", "text"]))


def _order(key: np.ndarray, stratum: np.ndarray, digest) -> np.ndarray:
    """The rows in the order of stratum, digest and place; ``key`` has the digests' first 64 bits, ``digest`` gives a row's whole."""
    bounds = np.concatenate([[0], np.nonzero(np.diff(stratum))[0] + 1, [len(stratum)]])
    if len(bounds) < 1_000:
        order = np.concatenate([low + np.argsort(key[low:high]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)])
    else:
        order = np.lexsort((key, stratum))
    same = (key[order[1:]] == key[order[:-1]]) & (stratum[order[1:]] == stratum[order[:-1]])
    if same.any():
        ends = np.nonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))[0]
        for low, high in zip(ends[::2], ends[1::2] + 1, strict=True):
            order[low:high] = sorted(order[low:high].tolist(), key=lambda k: (digest(k), k))
    return order


def _mean_share(cluster: np.ndarray, label: np.ndarray, clusters: int, labels: int, least: int = 3) -> float | None:
    """As ``purity``, of codes from 0."""
    cell = cluster.astype(np.int64) * labels + label
    if clusters * labels <= 4 * len(cell) + 1_024:
        n = np.bincount(cell, minlength=clusters * labels).reshape(clusters, labels)
        top, whole = n.max(1, initial=0), n.sum(1)
    else:
        at, n = np.unique(cell, return_counts=True)
        of, first = np.unique(at // labels, return_index=True)
        top, whole = (np.maximum.reduceat(n, first), np.add.reduceat(n, first)) if len(of) else (n, n)
    kept = whole >= least
    return float(np.mean(top[kept] / whole[kept])) if kept.any() else None


def _dealt_packed(pieces: DataFrame, names: list[str], shares: list[tuple[int, int]]) -> DataFrame:
    """``rung, rep, purity`` of the replicates of ``shares``, each share of each rung in a task with the rung's pieces."""
    cases = [(rung, k * len(shares) + i, low, high) for k, rung in enumerate(range(len(names))) for i, (low, high) in enumerate(shares)]
    plan = pieces.sparkSession.createDataFrame(cases, "rung int, task int, low int, high int")  # as many as tasks
    met = pieces.join(F.broadcast(plan), "rung").repartitionByRange(len(cases), "task")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rung, low, high = (int(pdf[c].iloc[0]) for c in ("rung", "low", "high"))
        read = lambda c: np.frombuffer(b"".join(pdf[c]), np.int32)
        place = np.argsort(read("at"))
        stratum, cluster, label, length = (read(c)[place] for c in ("first", "_cluster", "_label", "length"))
        data, starts = np.frombuffer(b"".join(pdf["text"]), np.uint8), (np.cumsum(read("length"), dtype=np.int64) - read("length"))[place]
        alike = []
        for size in np.unique(length):
            rows = np.nonzero(length == size)[0]
            text = np.empty((size, len(rows)), np.uint8)
            for k in range(size):
                text[k] = data[starts[rows] + k]
            alike.append((rows, text))
        inside = np.nonzero(cluster >= 0)[0]
        cluster, key, found = cluster[inside], np.empty(len(place), np.uint64), []
        clusters, labels = (int(x.max(initial=-1)) + 1 for x in (cluster, label))
        for rep in range(low, high):
            end = f"{names[rung]}|{rep}".encode()
            for rows, text in alike:
                key[rows] = md5_high(text, end)
            whole = lambda k, end=end: hashlib.md5(data[starts[k] : starts[k] + length[k]].tobytes() + end).digest()
            dealt = label[_order(key, stratum, whole)]
            found.append((rung, rep, _mean_share(cluster, dealt[inside], clusters, labels)))
        return pd.DataFrame([x for x in found if x[2] is not None], columns=["rung", "rep", "purity"])

    return met.groupBy("task").applyInPandas(run, "rung int, rep int, purity double")


def null_ladder(df: DataFrame, ident: str, cluster: str, label: str, rungs: dict[str, list[str]], reps: int) -> DataFrame:
    """``rung, observed, mean, delta, z`` for each way to stratify, from ``reps`` permutations.

    A replicate deals a stratum's labels to its places in the order of md5 of id, rung and replicate. The places are numbered
    once. Up to PACKED rows a replicate is put in order in one task, over packed columns that a task reads once for all
    of its replicates, so no row is shuffled for a replicate. Above, replicates of all rungs are put in order together, by
    hashes of runs of a stratum's digests, so neither a replicate nor a stratum is one task. A pass deals AT_ONCE or
    SPREAD_AT_ONCE rows or one replicate of each rung, so the disk that it takes doesn't grow with the number of
    replicates. z divides by the population deviation, 1e-9 at least.
    """
    rows = materialize(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([ident, cluster, label, *[c for s in rungs.values() for c in s]])), "rows")
    observed = purity(rows, cluster, label)
    packed = rows.count() <= PACKED
    if packed:
        coded = _coded(_coded(rows, cluster, "_cluster", F.col(cluster) >= 0), label, "_label")
        base = _ladder(coded, ident, "_cluster", "_label", rungs)
        pieces = materialize(_pieces(base, ident), "pieces")
    else:
        base = _ladder(rows, ident, cluster, label, rungs)
    names = F.create_map(*[F.lit(x) for k, name in enumerate(rungs) for x in (k, name)])

    def spread_purity(start: int, stop: int) -> DataFrame:
        """``rung, rep, purity`` of the replicates from ``start`` to before ``stop``."""
        many = base.select("rung", "first", "size", ident, F.col(label).alias("_dealt"), F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("rep"))
        many = many.withColumn("u", F.unhex(F.md5(F.concat_ws("|", F.col(ident).cast("string"), names[F.col("rung")], F.col("rep").cast("string")))))
        runs = F.ceil(F.col("size") / RUN)  # a run is a share of the digests' range
        high = F.conv(F.hex(F.substring("u", 1, 4)), 16, 10).cast("long")
        many = many.withColumn("run", F.when(runs > 1, F.shiftright(high * runs, 32)).otherwise(0))
        own = Window.partitionBy("rung", "rep", "first", "run").orderBy("u", ident)
        given = many.withColumn("nth", F.row_number().over(own) - 1)
        if not base.where(F.col("size") > RUN).isEmpty():
            sizes = many.where(F.col("size") > RUN).groupBy("rung", "rep", "first", "run").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("rung", "rep", "first").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
            starts = materialize(sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), "starts")
            given = given.join(starts, ["rung", "rep", "first", "run"], "left")
        else:
            given = given.withColumn("before", F.lit(0))
        given = given.select("rung", "rep", (F.col("first") + F.coalesce("before", F.lit(0)) + F.col("nth")).alias("at"), "_dealt")
        dealt = given.join(base.select("rung", "at", cluster), ["rung", "at"])
        return materialize(purity(dealt, cluster, "_dealt", ["rung", "rep"]), "purities", files=1)

    def packed_purity(start: int, stop: int) -> DataFrame:
        each = math.ceil((stop - start) * len(rungs) / (2 * df.sparkSession.sparkContext.defaultParallelism))
        shares = [(low, min(low + each, stop)) for low in range(start, stop, each)]
        found = _dealt_packed(pieces, list(rungs), shares)
        return materialize(found, "purities", files=1)

    step = max(1, (AT_ONCE if packed else SPREAD_AT_ONCE) // max(1, base.count()))
    found = None
    for low in range(0, reps, step):
        one = (packed_purity if packed else spread_purity)(low, min(low + step, reps))
        found = one if found is None else found.unionByName(one)
        if low + step < reps:  # Spark deletes the shuffle files of what the driver no longer holds
            gc.collect()
            df.sparkSession._jvm.System.gc()
    null = found.groupBy("rung").agg(F.avg("purity").alias("mean"), F.stddev_pop("purity").alias("sd"))
    delta = F.col("observed") - F.col("mean")
    return null.crossJoin(F.broadcast(observed.withColumnRenamed("purity", "observed"))).select(names[F.col("rung")].alias("rung"), "observed", "mean", delta.alias("delta"), (delta / F.greatest("sd", F.lit(1e-9))).alias("z"))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, as a sum of logarithms."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log((n - k + i).cast("double") / i))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) of a binomial; 1 for k <= 0. ``n`` and ``k`` are longs, ``p`` is between 0 and 1."""
    first = log_choose(n, k) + k * F.log(p) + F.when(n > k, (n - k) * F.log1p(-p)).otherwise(0.0)
    more = F.when(n > k, F.sequence(k + 1, n)).otherwise(F.array().cast("array<bigint>"))
    # each term from the one before: (n - i + 1) / i * p / (1 - p)
    total = F.aggregate(more, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, i: F.struct((s.term * (n - i + 1) / i * p / (1 - p)).alias("term"), (s["sum"] + s.term * (n - i + 1) / i * p / (1 - p)).alias("sum")))
    return F.when(k <= 0, 1.0).when(p >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.exp(first) * total["sum"]))


def enrichment(df: DataFrame, cluster: str, label: str, least: int = 2) -> DataFrame:
    """``cluster, members, top_label, top_n, frac, p, q_bh`` for clusters of ``least`` labelled members or more.

    The base rate is over all labelled rows, singletons too; of equal counts the least label is the top one.
    """
    rows = df.where(F.col(label).isNotNull())
    rates = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.count()
    counts = rows.where(F.col(cluster) >= 0).groupBy(cluster, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(F.col(cluster).alias("cluster")).agg(F.sum("n").alias("members"), F.min_by(F.struct(F.col(label).alias("top_label"), F.col("n").alias("top_n")), F.struct(-F.col("n"), F.col(label))).alias("x")).where(F.col("members") >= least)
    rated = top.select("cluster", "members", "x.*").join(rates, F.col("top_label") == F.col(label))
    tested = rated.select("cluster", "members", "top_label", "top_n", (F.col("top_n") / F.col("members")).alias("frac"), binomial_tail(F.col("members"), F.col("top_n"), F.col("_n") / F.lit(float(total))).alias("p"))
    return benjamini_hochberg(tested, "p", "q_bh", "cluster")


def match_rule(sets: DataFrame, labels: DataFrame, tests: DataFrame, group: str, member: str, cluster: str, share: float = 0.75, most_q: float = 0.15) -> DataFrame:
    """For each group its main cluster, the fraction of all its members there, the cluster's q, and ``kept``.

    Members without a cluster count in the denominator; a cluster without a test isn't kept.
    """
    joined = sets.join(labels.select(member, cluster), member, "left")
    sizes = joined.groupBy(group).agg(F.count("*").alias("members"))
    counts = joined.where(F.col(cluster) >= 0).groupBy(group, cluster).agg(F.count("*").alias("n"))
    main = counts.groupBy(group).agg(F.min_by(F.struct(F.col(cluster).alias("main"), "n"), F.struct(-F.col("n"), F.col(cluster))).alias("x")).select(group, "x.*")
    out = sizes.join(main, group, "left").join(tests.select(F.col("cluster").alias("main"), F.col("q_bh").alias("q")), "main", "left")
    fraction = F.coalesce(F.col("n"), F.lit(0)) / F.col("members")
    return out.select(group, "members", "main", fraction.alias("fraction"), "q", F.coalesce((fraction >= share) & (F.col("q") <= most_q), F.lit(False)).alias("kept"))


def overlaps(df: DataFrame, one: str, other: str) -> DataFrame:
    """``direction, cluster, members, best, shared, fraction``: for every cluster of either partition the other's cluster that has
    most of its members, of equals the least, and the fraction of all its members there. -1 and null are no cluster, but
    count among the members of the other's."""
    out = None
    for name, a, b in ((f"{one} in {other}", one, other), (f"{other} in {one}", other, one)):
        inside = df.where(F.col(a).isNotNull() & (F.col(a).cast("string") != "-1"))
        cells = inside.groupBy(F.col(a).cast("string").alias("cluster"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
        met = F.col("b").isNotNull() & (F.col("b") != "-1")
        top = cells.groupBy("cluster").agg(F.sum("n").alias("members"), F.max(F.when(met, F.col("n"))).alias("shared"))
        first = cells.where(met).join(top.select(F.col("cluster").alias("c"), "shared"), (F.col("cluster") == F.col("c")) & (F.col("n") == F.col("shared"))).groupBy(F.col("cluster").alias("of")).agg(F.min("b").alias("best"))
        each = top.join(first, F.col("cluster") == F.col("of"), "left").select(F.lit(name).alias("direction"), "cluster", "members", "best", F.coalesce("shared", F.lit(0)).alias("shared"))
        out = each if out is None else out.unionByName(each)
    return out.withColumn("fraction", F.col("shared") / F.col("members"))


def verdicts(sets: DataFrame, labels: DataFrame, group: str, member: str, cluster: str) -> DataFrame:
    """``also``, ``partly`` or ``not``: 0.75 and 0.5 of all members share one cluster; singletons don't vote."""
    empty = labels.sparkSession.createDataFrame([], f"cluster {dict(labels.dtypes)[cluster]}, q_bh double")
    m = match_rule(sets, labels, empty, group, member, cluster)
    return m.select(group, "members", "main", "fraction", F.when(F.col("fraction") >= 0.75, "also").when(F.col("fraction") >= 0.5, "partly").otherwise("not").alias("verdict"))


def _draw(seed: str) -> Column:
    """32 bits of md5 of the draw's number and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")


def random_pairs(spark: SparkSession, n: int, draws: int) -> DataFrame:
    """``draw, a, b``: places 0 to n - 1 with replacement, pairs of one place dropped."""
    d = spark.range(draws).withColumnRenamed("id", "draw")
    return d.select("draw", (_draw("a") % n).alias("a"), (_draw("b") % n).alias("b")).where("a != b")


def random_triples(spark: SparkSession, n: int, draws: int) -> DataFrame:
    """``draw, a, b, c``: places 0 to n - 1 with replacement; repeated places stay."""
    return spark.range(draws).withColumnRenamed("id", "draw").select("draw", *[(_draw(x) % n).alias(x) for x in "abc"])


def within_class_pairs(df: DataFrame, ident: str, label: str, draws: int) -> DataFrame:
    """``draw, a, b``: the class by its size, both members uniform in it; pairs of one member dropped.

    Rows are numbered by class, so a drawn number is a row, whose class it is: equi-joins alone, however many classes.
    """
    from tarn.operators.ordered import running_sum

    k = df.groupBy(label).agg(F.count("*").alias("k"))
    ranges = running_sum(k, [label], "k", "hi").select(F.col(label).alias("_of"), "k", (F.col("hi") - F.col("k")).alias("lo"))
    # member numbers by class, from one range-sorted numbering
    numbered = row_numbers(df.select(F.col(label).alias("_c"), F.col(ident).alias("_id")), ["_c", "_id"], "_g")
    numbered = materialize(numbered, "numbered")
    n = df.count()
    d = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", _draw("c") % n)
    placed = d.join(numbered.select(F.col("_g").alias("u"), "_c"), "u").join(ranges, F.col("_c").eqNullSafe(F.col("_of")))
    ends = placed.select("draw", (F.col("lo") + _draw("a") % F.col("k")).alias("ga"), (F.col("lo") + _draw("b") % F.col("k")).alias("gb"))
    a = numbered.select(F.col("_g").alias("ga"), F.col("_id").alias("a"))
    b = numbered.select(F.col("_g").alias("gb"), F.col("_id").alias("b"))
    return ends.join(a, "ga").join(b, "gb").select("draw", "a", "b").where("a != b")
