"""Cases in which results differed from SQL, and laws of what replaced jobs that didn't fit."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tarn.functions import numeric
from tarn.operators import distances


def test_rounded_as_sql(spark):
    """Halves after scaling, tiny negatives, and what has no digits or too many."""
    values = [0.5e-6, -0.5e-6, -1e-9, 1e-9, -0.0, 0.0, 0.1234565, -0.1234565, 2.5e-6, 1e305, float("inf"), float("nan"), None]
    got = [r["v"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(1).orderBy("i").select(numeric.rounded(F.col("v"), 6).alias("v")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_bundle_keeps_the_sign_of_zero(spark, tmp_path):
    """A tiny negative component is -0.0 at six digits, as in SQL."""
    import tarn.plans as plans

    spark.createDataFrame([(1, [-1e-9] * 64, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, column in (("K03_array_bundle", "embedding"), ("S14_block_scan", "block")):
        assert {str(x) for x in plans.QUERIES[name](spark, f"file://{tmp_path}").first()[column]} == {"-0.0"}


def test_sessions_by_whole_seconds(spark):
    """3,600.6 s apart are 3,601 whole seconds, 3,600.4 s are 3,600; equal times are one session."""
    from tarn.streaming import batches

    rows = [("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 01:00:00.6"), ("b", "2024-01-01 00:00:00.4"), ("b", "2024-01-01 01:00:00.5"), ("c", "2024-01-01 00:00:00.5"), ("c", "2024-01-01 01:00:01.4"), ("c", "2024-01-01 01:00:01.4")]
    events = spark.createDataFrame(rows, "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = sorted(tuple(r) for r in batches.sessions(events, "u", "t", 3600).collect())
    assert got == [("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("c", 0, 1), ("c", 1, 2)]


def test_kind_by_a_first_line_longer_than_the_head():
    """a separator, a zero byte or the line's end beyond the first bytes counts; what follows the line doesn't."""
    import io

    from tarn.sources import files

    far = b"x" * (files.HEAD + 7)
    for content, kind in ((far + b",y\nz", "table"), (far + b"\ny,z", "text"), (far, "text"), (far + b";\0", "binary"), (b"a," + far + b"\0\n", "binary"), (b"x" * (files.HEAD + files.STEP) + b"\tz", "table"), (b"x" * (files.HEAD - 1) + b"\n,", "text"), (b"x\n" + far + b",", "text")):
        assert files._looked_at(io.BytesIO(content)) == (len(content), kind)


def _quantile(x, p):
    """Linear, as SQL has it."""
    x, at = sorted(x), p * (len(x) - 1)
    return x[int(at)] + (x[min(int(at) + 1, len(x) - 1)] - x[int(at)]) * (at - int(at))


def test_percentiles_of_all_pairs(spark):
    """As of the listed pairs, with copies, unknown groups and tiles of several sizes; one row has no pair."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(70, 5))
    v[40:50] = v[3]
    label = [None if i % 9 == 0 else int(i % 3) for i in range(70)]
    df = spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(70)], "id long, v array<double>, g int")
    pairs = [(math.dist(v[i], v[j]), None if None in (label[i], label[j]) else label[i] == label[j]) for i in range(70) for j in range(i)]
    for size in (9, 64):
        got = distances.pair_percentiles(df, "id", "v", [0.0, 0.01, 0.5, 1.0], group="g", size=size)
        assert set(got) == {True, False, None}
        for same, (n, values) in got.items():
            held = [d for d, s in pairs if s is same]
            assert n == len(held) and np.allclose(values, [_quantile(held, p) for p in (0.0, 0.01, 0.5, 1.0)], atol=1e-12)
    assert distances.pair_percentiles(df, "id", "v", [0.5])[True][0] == len(pairs)
    assert distances.pair_percentiles(df.limit(1), "id", "v", [0.5]) == {}


def test_parts_of_all_pairs(spark):
    """sums over tiles are those over the pairs."""
    v = np.random.default_rng(6).normal(size=(30, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = [math.dist(v[i], v[j]) for i in range(30) for j in range(i)]
    for size in (7, 64):
        parts = distances.pair_parts(df, "id", "v", ["total", "most"], lambda a, b, once: (once(distances._between(a, b)).sum(), once(distances._between(a, b)).max()), size=size).toPandas()
        assert parts["n"].sum() == len(d) and abs(parts["total"].sum() - sum(d)) < 1e-9 and abs(parts["most"].max() - max(d)) < 1e-12


def test_rounds_keep_whole_edges_only(spark):
    """rounds, the last task and the dense matrix give the same clusters; a round leaves only whole edges."""
    from tarn.operators import clustering

    v = np.random.default_rng(9).normal(size=(60, 3))
    d = np.array([[math.dist(x, y) for y in v] for x in v])
    cut = float(np.quantile(d[np.triu_indices(60, 1)], 0.4))
    close = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= cut], "a long, b long, d double")
    want = clustering.agglomerate(np.where(d <= cut, d, np.inf), cut)
    for few in (1_000, 40):
        got = {r["id"]: r["raw"] for r in clustering.merged_in_rounds(close, few).collect()}
        assert all(got[i] == want[i] for i in got) and len(set(want)) < 60
    edges = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5), (2, 3, 0.6), (1, 4, 0.7)], "x long, y long, d double")
    assert [tuple(r) for r in clustering._cross(edges, spark.createDataFrame([(2, 1)], "c long, to long")).collect()] == [(1, 3, 0.6)]


def test_percentiles_by_counts(spark):
    """as SQL's, with ties and nulls; none of no values."""
    from tarn.operators import ordered

    x = [float(i * i % 37) for i in range(101)]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    assert np.allclose(ordered.percentiles(df, "v", [0.0, 0.013, 0.5, 0.9, 1.0]), [_quantile(x, p) for p in (0.0, 0.013, 0.5, 0.9, 1.0)])
    assert ordered.percentiles(df.where("v IS NULL"), "v", [0.5]) == [None]


def test_tiles_do_not_grow_in_number(spark):
    """a row is sent once a tile, so their number stays until they are full."""
    of = lambda n, width: distances.tile_size(spark.range(n).select("id", F.array_repeat(F.lit(0.0), width).alias("v")), "v")
    assert of(10, 3) == 64 and of(24_000, 2) == 1_000 and of(240_000, 2) == 10_000 and of(24_000, 4_096) == 256


def test_values_of_drawn_groups_without_their_rows(spark, monkeypatch):
    """as of the groups that are drawn row by row, where bounds fit and where they don't; most rows aren't put in order."""
    from tarn.operators import panel

    df = spark.range(6_000).select("id", ((F.col("id") * 37) % 1009).cast("double").alias("v"))
    held = []
    monkeypatch.setattr(panel, "materialize", lambda d, name="table", files=None, kept=panel.materialize: [got := kept(d, name, files), held.append((name, got.count()))][0])
    for sizes, factor in (([1, 4_000, 6_000], 1), ([4_000], 0)):
        if not factor:  # both bounds at the size itself: about half of the draws miss it on either side
            monkeypatch.setattr(panel.math, "sqrt", lambda x: -5.0)
        want = {(r["draw"], r["size"]): r["v"] for r in panel.drawn_groups(df, "id", ["v"], sizes, 6).groupBy("draw", "size").agg(F.sum("v").alias("v")).collect()} if factor else want
        held.clear()
        got = {(r["draw"], r["size"]): r["_v"] for r in panel.group_values(df, "id", F.sum("v"), ["v"], sizes, 6).collect()}
        assert got == {k: v for k, v in want.items() if k[1] in sizes}
        if factor:
            assert sum(n for name, n in held if name == "met") < 6 * 2 * (6 * 4_000**0.5 + 6_000**0.5 * 6 + 100)


def test_structures_go_in_bounded_parts(spark):
    """however many rows a batch has, few are held with their features; the rows and their order stay."""
    from tarn.operators import frames

    n = 3 * frames.TOGETHER + 5
    df = spark.range(0, n, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k + F.col("id")).cast("float")).alias("p"))

    def f(p):
        return {"m": np.full(len(p), float(len(p))), "x": p[:, :, 0]}

    got = frames.map_structures(df, "id", "p", ["m", "x"], f).collect()
    assert [(r["id"], r["x"]) for r in got] == [(i, [float(i), float(i + 3)]) for i in range(n)]
    assert max(r["m"][0] for r in got) <= frames.TOGETHER


def test_hamming_pairs_by_tiles(spark, monkeypatch):
    """as of the joined pairs, over several tiles a group, with equal ids, nulls, other lengths and letters beyond a byte."""
    from tarn.operators import relations

    names = ["karo", "karl", "kérl", "k\u0142rl", "ka", "karolin", None]
    rows = [(i % 40, i % 3 if i % 11 else None, names[i % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, s string")
    x, y = df.toDF("a", "g", "x"), df.toDF("b", "g", "y")
    want = sorted(map(repr, x.join(y, "g").where("a < b").select("a", "b", relations.hamming("x", "y").cast("long").alias("h")).collect()))
    for size in (4, 2_048):
        monkeypatch.setattr(relations, "NAMES", size)
        assert sorted(map(repr, relations.hamming_pairs(df, "id", "g", "s").collect())) == want
    assert relations.hamming_pairs(df.limit(0), "id", "g", "s").count() == 0


def test_nearest_by_few_tiles(spark):
    """rows and candidates are sent once for each tile, so few large ones; the bound loses no neighbour."""
    of = lambda n, width: distances.tile_size(spark.range(n).select("id", F.array_repeat(F.lit(0.0), width).alias("v")), "v", distances.NEAR_TILES, distances.NEAR_BYTES)
    assert of(240_000, 8) == 30_000 and of(24_000, 4_096) == 1_024
    rng = np.random.default_rng(8)
    v = rng.integers(0, 4, (900, 3)).astype(float)  # many ties
    v[7] = math.nan
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for size in (None, 900, 130):
        got = {}
        for r in distances.nearest(df, "id", "v", 3, size=size).collect():
            got.setdefault(r["a"], []).append((r["d"], r["b"]))
        assert set(got) == set(range(900)) - {7}
        for i, found in got.items():
            assert sorted(found) == sorted((round(d[i, j], 9), j) for j in range(900) if j not in (i, 7))[:3]
    cells = rng.random((5, 1_000))
    assert all((row <= b).sum() >= 6 for row, b in zip(cells, distances._kth(cells, 6), strict=True))


def test_ladder_in_passes(spark, monkeypatch):
    """the same figures from passes of a few replicates, the last one shorter; no pass holds them all."""
    from tarn.operators import labels

    df = spark.range(90).select("id", (F.col("id") % 7).alias("c"), (F.col("id") * 13 % 5).alias("l"), (F.col("id") % 2).alias("s"))
    found = lambda: sorted((r["rung"], round(r["mean"], 12), round(r["z"], 9)) for r in labels.null_ladder(df, "id", "c", "l", {"free": [], "s": ["s"]}, 5).collect())
    want, held = found(), []
    monkeypatch.setattr(labels, "materialize", lambda d, name="table", files=None, kept=labels.materialize: [got := kept(d, name, files), held.append((name, got))][0])
    monkeypatch.setattr(labels, "AT_ONCE", 2 * 180 + 1)
    assert found() == want
    assert [d.select("rep").distinct().count() for name, d in held if name == "purities"] == [2, 2, 1]


def test_listed_pairs_by_few_tiles(spark, monkeypatch):
    """a table of pairs sends every row once for each of a few tiles, and the pairs stay all there."""
    made = []
    monkeypatch.setattr(distances, "_paired", lambda df, ident, found, t, kept=distances._paired: [made.append(t.count()), kept(df, ident, found, t)][1])
    v = np.random.default_rng(12).normal(size=(700, 3))
    got = distances.all_pairs(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v").collect()
    assert made == [distances.NEAR_TILES]
    assert {(r["a"], r["b"]): round(r["d"], 9) for r in got} == {(i, j): round(math.dist(v[i], v[j]), 9) for i in range(700) for j in range(i + 1, 700)}
    assert len(got) == 700 * 699 // 2
