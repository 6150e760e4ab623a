"""Values of the operators without SQL against plain versions, laws and known cases."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

import tarn.plans as plans
from tarn.functions import sequence
from tarn.operators import clustering, distances, frames, labels, panel

SF = "/root/testdata/sf0.001"


def result(spark, name):
    return plans.QUERIES[name](spark, SF)


def points(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.array(r["embedding"][:63], float).reshape(-1, 3) for r in rows}


def walked(p, n):
    """Places at equal steps along a path, by walking it."""
    lengths = [math.dist(a, b) for a, b in zip(p, p[1:])]
    out = []
    for k in range(n):
        left = sum(lengths) * k / (n - 1)
        for a, b, d in zip(p, p[1:], lengths):
            if left <= d + 1e-12 or b is p[-1]:
                out.append([x + (y - x) * min(1.0, left / d if d else 0.0) for x, y in zip(a, b)])
                break
            left -= d
        else:
            out.append(list(p[-1]))
    return np.array(out)


def test_resampled_paths(spark):
    p = points(spark)
    for name, column, n, pick in (("N08_site_descriptor", "site", 10, slice(None)), ("N13_landmarks", "landmarks", 40, slice(None, None, 4))):
        for r in result(spark, name).orderBy("vec_id").limit(25).collect():
            assert np.allclose(np.reshape(r[column], (-1, 3)), walked(p[r["vec_id"]], n)[pick], atol=1e-6), name
    for r in result(spark, "X24_nearest_resample").orderBy("vec_id").limit(25).collect():
        got, own, s = np.reshape(r["v"], (-1, 3)), p[r["vec_id"]], 0.0
        arc = [0.0] + list(itertools.accumulate(math.dist(a, b) for a, b in zip(own, own[1:])))
        for k, g in enumerate(got):
            assert np.allclose(g, own[min(range(len(own)), key=lambda i: (abs(arc[i] - arc[-1] * k / 7), i))])


def test_axes_are_a_right_handed_frame_along_the_spread(spark):
    p = points(spark)
    for r in result(spark, "N05_principal_axes").orderBy("vec_id").limit(40).collect():
        a, c = np.reshape(r["axes"], (3, 3)), p[r["vec_id"]] - p[r["vec_id"]].mean(0)
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and np.allclose(np.cross(a[0], a[1]), a[2], atol=1e-9)
        spread = ((c @ a.T) ** 2).sum(0)
        assert spread[2] >= spread[0] - 1e-9 >= spread[1] - 2e-9 and ((c @ a[2]) ** 3).sum() >= -1e-9
    share = np.mean([np.reshape(r["axes"], (3, 3))[2][2] > 0 for r in result(spark, "N05_principal_axes").collect()])
    assert abs(result(spark, "N06_axis_validation").first()["positive"] - share) < 1e-6


def test_shape_moments(spark):
    """All five channels; a group of three points has zeros."""
    from tarn.operators import frames

    rng = np.random.default_rng(3)
    rows = [(s, c, i, *map(float, rng.normal(size=3) * 4)) for s in range(6) for c, n in (("all", 21), ("few", 3), ("four", 4)) for i in range(n)]
    rows += [(9, "flat", i, 1.0, 1.0, 1.0) for i in range(5)]
    got = {(r["s"], r["channel"], r["reference"]): (r["mean"], r["sd"], r["skew"]) for r in frames.shape_moments(spark.createDataFrame(rows, "s long, channel string, pos long, x double, y double, z double"), ["s", "channel"], "pos").collect()}
    assert len(got) == 4 * 19
    for s, c in {r[:2] for r in rows}:
        own = [list(r[3:]) for r in rows if r[:2] == (s, c)]
        centre = [sum(x) / len(own) for x in zip(*own, strict=True)]
        near, far = min(own, key=lambda x: math.dist(x, centre)), max(own, key=lambda x: math.dist(x, centre))
        for name, ref in (("centroid", centre), ("nearest", near), ("farthest", far), ("opposite", max(own, key=lambda x: math.dist(x, far)))):
            d = [math.dist(x, ref) for x in own]
            m = sum(d) / len(d)
            third = sum((x - m) ** 3 for x in d) / len(d)
            want = (m, math.sqrt(sum((x - m) ** 2 for x in d) / len(d)), math.copysign(abs(third) ** (1 / 3), third)) if len(own) >= 4 else (0, 0, 0)
            assert np.allclose(got[s, c, name], want, atol=1e-6)


def test_pair_vectors(spark):
    p = points(spark)
    for name, n in (("N14_vector_features", 20), ("N15_vector_features_30", 30)):
        for r in result(spark, name).orderBy("vec_id").limit(8).collect():
            own = p[r["vec_id"]]
            a, b = walked(own[:10], n), walked(own[10:], n)
            assert r["k"] == 3 * n * n
            if "norm2" in r:
                assert abs(r["norm2"] - sum(math.dist(x, y) ** 2 for x in a for y in b)) < 1e-4
    for r in result(spark, "N16_accepted_pair_features").orderBy("vec_id").limit(8).collect():
        own = p[r["vec_id"]]
        model = np.array([[float(np.sign(x) * math.floor(abs(x) * 10 + 0.5) / 10) for x in row] for row in own])
        f = lambda q: np.array([y - x for x in walked(q[:10], 10) for y in walked(q[10:], 10)])
        assert abs(r["d"] - math.sqrt(((f(own) - f(model)) ** 2).sum())) < 1e-4


def turned(p, angle, axis):
    axis = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return p @ (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k).T


def test_fits_hinge_and_core(spark):
    rng = np.random.default_rng(4)
    ref = rng.normal(size=(20, 3))
    rows = [(i, (turned(ref, 0.3 * i, [1, i, 2]) + i).ravel().tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, p array<double>")
    assert all(r["value"] < 1e-7 for r in frames.fitted_deviation(df, "id", "p", ref).collect())
    assert all(np.allclose(np.reshape(r["value"], (-1, 3)), ref, atol=1e-7) for r in frames.placed(df, "id", "p", ref).collect())
    bent = np.concatenate([ref[:10], turned(ref[10:], 0.7, [0, 0, 1])])
    assert abs(np.linalg.norm(frames.hinge(turned(bent, 1.1, [3, 1, 2]), ref)) - 0.7) < 1e-6 and np.linalg.norm(frames.hinge(turned(ref, 1.1, [3, 1, 2]), ref)) < 1e-5
    off = [(i, (turned(ref + (np.arange(20) >= 18)[:, None] * rng.normal(size=(20, 3)), 0.2 * i, [1, 1, 0])).ravel().tolist()) for i in range(8)]
    assert frames.rigid_core(spark.createDataFrame(off, "id long, p array<double>"), "id", "p", ref).tolist() == list(range(18))


def test_reference_is_the_medoid(spark):
    p = points(spark)
    few = {i: p[i] for i in sorted(p)[:40]}
    df = spark.createDataFrame([(i, q.ravel().tolist()) for i, q in few.items()], "id long, p array<double>")

    def apart(a, b):
        r, t = frames.kabsch(a, b)
        return ((a @ r + t - b) ** 2).sum()

    want = min(few, key=lambda i: sum(apart(few[i], q) for q in few.values()))
    assert frames.medoid(df, "id", "p")[0] == want


def test_exposed_points():
    """A lone point is free, two far ones too, and one in a closed shell isn't."""
    whole = 4 * math.pi * 3.1**2
    assert np.allclose(frames.exposed(np.zeros((1, 3))), whole) and np.allclose(frames.exposed(np.array([[0, 0, 0], [9.0, 0, 0]])), whole)
    two = frames.exposed(np.array([[0, 0, 0], [2.0, 0, 0]]), dots=4000)
    assert np.allclose(two, whole * (0.5 + 1 / 3.1 / 2), rtol=0.01)  # a cap of height reach - 1 is covered
    k = np.arange(60) + 0.5
    z, t = 1 - k / 30, math.pi * (1 + 5**0.5) * k
    shell = 2.5 * np.stack([np.sqrt(1 - z * z) * np.cos(t), np.sqrt(1 - z * z) * np.sin(t), z], 1)
    assert frames.exposed(np.concatenate([np.zeros((1, 3)), shell]))[0] == 0


def test_nearest_in_tiles_and_groups(spark):
    rng = np.random.default_rng(3)
    v, g = rng.integers(0, 4, (70, 3)).astype(float), rng.integers(0, 3, 70)
    df = spark.createDataFrame([(i, v[i].tolist(), int(g[i])) for i in range(70)], "id long, v array<double>, g int")
    for group in (None, "g"):
        got = {(r["a"], r["b"]) for r in distances.nearest(df, "id", "v", 4, group=group, size=9).collect()}
        want = set()
        for a in range(70):
            others = [b for b in range(70) if b != a and (group is None or g[a] == g[b])]
            want |= {(a, b) for b in sorted(others, key=lambda b: (round(math.dist(v[a], v[b]), 9), b))[:4]}
        assert got == want
    near = distances.all_pairs(df, "id", "v", size=16, most=1.5).collect()
    assert {(r["a"], r["b"]) for r in near} == {(a, b) for a in range(70) for b in range(a + 1, 70) if math.dist(v[a], v[b]) <= 1.5}


def test_rounds_of_merges_equal_the_dense_agglomeration(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<double>")
    pairs = distances.all_pairs(df, "id", "v")
    dense = clustering.complete_linkage(df, pairs, "id", 1.2).orderBy("id").collect()
    monkeypatch.setattr(clustering, "LARGEST", 5)
    assert clustering.complete_linkage(df, pairs, "id", 1.2).orderBy("id").collect() == dense
    assert len({r["cluster"] for r in dense}) > 5


def test_cluster_invariant(spark):
    r = result(spark, "N37_cluster_invariant").first()
    assert r["inside"] == r["within_cut"] > 0 and 0 < r["widest"] <= r["cut"]


def test_markers(spark):
    for r in result(spark, "N70_markers").collect():
        assert abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-12 and r["q"] >= r["p"] - 1e-12 and r["marker"] == (r["q"] < 0.05 and r["z"] > 0)


def test_variable_features(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    chosen = sorted(sorted(range(x.shape[1]), key=lambda i: (-x[:, i].var() / max(np.abs(x[:, i]).mean(), 1e-12), i))[:32])
    z = np.clip((x[:, chosen] - x[:, chosen].mean(0)) / x[:, chosen].std(0), -10, 10)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = {r["vec_id"]: np.abs(z[k] @ v[:4].T) for k, r in enumerate(rows)}
    for r in result(spark, "N65_variable_features").collect():
        assert np.allclose(r["components"], want[r["vec_id"]], atol=1e-4)


def test_within_class_draws(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc") if i % 9 else None) for i in range(90)]
    of = dict(rows)
    got = labels.within_class_pairs(spark.createDataFrame(rows, "id long, c string"), "id", "c", 3000).collect()
    assert len(got) > 2800 and all(of[r["a"]] == of[r["b"]] and r["a"] != r["b"] for r in got)
    share = sum(of[r["a"]] == "a" for r in got) / len(got)
    assert abs(share - sum(c == "a" for c in of.values()) / 90) < 0.05


def test_sequence_queries(spark):
    nations = [(r[0], r[1].upper()) for r in spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", "n_name").collect()]
    name = dict(nations)
    for r in result(spark, "N32_paired_sequence_distance").limit(60).collect():
        x, y = name[r["a"]], name[r["b"]]
        one = spark.createDataFrame([(x, y, x[:6], y[:6])], "x string, y string, u string, v string") if r["a"] < 3 else None
        if one is not None:
            assert one.select((sequence.junction_distance("x", "y") + sequence.germline_distance("u", "v")).alias("d")).first()["d"] == r["d"]
        assert r["d"] >= 0
    table = {r["d"]: r["pairs"] for r in result(spark, "N33_distinct_sequence_matrix").collect()}
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert sum(table.values()) == n * (n - 1) // 2


def test_ridge_against_direct_solves(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.choice("xy"), 0.0) for i in range(200)]
    rows = [(i, a, c, 3 * a + (c == "x") + rng.gauss(0, 0.1)) for i, a, c, _ in rows]
    df = spark.createDataFrame(rows, "id long, a double, c string, y double")
    fold = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f")).collect()}
    x = np.array([[1, a, c == "x", c == "y"] for _, a, c, _ in rows], float)
    y, f = np.array([r[3] for r in rows]), np.array([fold[r[0]] for r in rows])
    fit = np.zeros(200)
    for k in range(5):
        xs, ys = x[f != k], y[f != k]
        fit[f == k] = x[f == k] @ np.linalg.solve(xs.T @ xs + np.diag([0.0, 1, 1, 1]), xs.T @ ys)
    want = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(panel.ridge_r2(df, "id", "y", ["a"], {"c": ["x", "y"]}).first()["r2"] - want) < 1e-9


def test_contacts_in_the_own_frame(spark):
    """N06 from its definition: touching by all distances, angles by plain vectors, axes from the rotation's own eigenvector."""
    p, above, angles, away = points(spark), [], [], []
    for own in p.values():
        a, b = own[:10], own[10:20]
        u, _, v = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
        values, vectors = np.linalg.eig(r)
        z = np.real(vectors[:, np.argmin(abs(values - 1))])
        o = own[[7, 9, 17, 19]].mean(0)
        z = z if (own[[8, 9, 18, 19, 20]].mean(0) - o) @ z >= 0 else -z
        if min(math.dist(x, y) for x in 8 * own[:18] for y in 8 * own[18:]) > 5:
            continue
        c = 8 * (own[18:].mean(0) - o)
        above.append(c @ z > 0)
        angles.append(math.degrees(math.acos(np.clip(c @ z / np.linalg.norm(c), -1, 1))))
        away.append(np.linalg.norm(c - (c @ z) * z))
    got = result(spark, "N06_contact_validation").first()
    assert got["touching"] == len(above) > 0 and abs(got["above"] - np.mean(above)) < 1e-6
    assert abs(got["angle"] - np.median(angles)) < 1e-3 and abs(got["off_axis"] - np.median(away)) < 1e-3


def test_poses_and_sites_of_the_queries(spark):
    """Distances of the poses that a plain version places; N08: places of the loops, and null for the loop that is missing."""
    from tarn.operators import frames

    p = points(spark)
    df = spark.createDataFrame([(int(k), v.ravel().tolist()) for k, v in p.items()], "vec_id long, points array<double>")
    _, ref = frames.medoid(df, "vec_id", "points")
    for r in result(spark, "N17_pose_distance").orderBy("a").limit(20).collect():
        x, y = (frames.two_way_pose(p[r[c]], ref, 10) for c in "ab")
        assert abs(r["d_hinge"] - math.sqrt(((x - y) ** 2).sum() / 21)) < 1e-5
    marks = [*range(5), *range(10, 15)]
    for r in result(spark, "N08_site_in_frame").orderBy("vec_id").limit(20).collect():
        own = p[r["vec_id"]]
        turn, shift = frames.kabsch(own[marks], ref[marks])
        site = np.array([math.nan if v is None else v for v in r["site"]]).reshape(4, 10, 3)
        for k, loop in enumerate((slice(5, 8), slice(8, 10), slice(15, 18), slice(18, 21))):
            if k == 2 and r["vec_id"] % 7 == 0:
                assert np.isnan(site[k]).all()
            else:
                assert np.allclose(site[k], walked(own[loop], 10) @ turn + shift, atol=1e-5)
