"""Arc lengths, pseudo-dyads, poses, splits, matched controls and gaps, against plain versions and planted answers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import sequence
from tarn.operators import cells, frames, relations, voxel


def turn(axis, angle):
    """Rotation for column vectors, by Rodrigues' formula."""
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def any_turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


@pytest.mark.parametrize("n", [2, 5, 10, 37])
def test_arc_places(spark, n):
    """Paths of one point, without length, with repeated points, and random ones."""
    rng = np.random.default_rng(n)
    paths = {0: rng.normal(size=(12, 3)), 1: rng.normal(size=(1, 3)), 2: np.ones((4, 3)), 3: np.repeat(rng.normal(size=(5, 3)), 2, 0), 4: rng.normal(size=(2, 3)), 5: np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]])}
    values = {k: rng.normal(size=len(p)) for k, p in paths.items()}
    rows = [(k, i * 7, *map(float, xyz), float(values[k][i])) for k, p in paths.items() for i, xyz in enumerate(p)]
    got = frames.arc_places(spark.createDataFrame(rows, "k long, at long, x double, y double, z double, v double").repartition(3), ["k"], "at", ["v", "x"], n).collect()
    assert sorted((r["k"], r["place"]) for r in got) == [(k, i) for k in paths for i in range(n)]
    for k, p in paths.items():
        s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        want = np.interp(np.linspace(0, s[-1], n), s, values[k]) if s[-1] else np.repeat(values[k][0], n)
        own = [r["v"] for r in sorted(got, key=lambda r: r["place"]) if r["k"] == k]
        if k != 3:  # where points repeat, another value may stand at the same length
            assert np.allclose(own, want, atol=1e-9)
        walked = frames.arc_resampled(p, n)
        assert np.allclose([r["x"] for r in sorted(got, key=lambda r: r["place"]) if r["k"] == k], walked[:, 0], atol=1e-9)


def test_a_planted_dyad_is_found():
    """Two chains, one the other turned by a known angle about a known axis, wherever the whole lies."""
    rng = np.random.default_rng(2)
    for angle in (3.0, math.pi, 2.2, 0.7):
        axis = rng.normal(size=3)
        axis /= np.linalg.norm(axis)
        a = rng.normal(size=(30, 3)) * 8
        b = a @ turn(axis, angle).T
        up, across = axis * 5 + rng.normal(size=3) * 0.1, np.cross(axis, rng.normal(size=3)) + axis
        f = frames.intrinsic_axes(a, b, np.zeros(3), up, across)
        assert np.allclose(f["axes"][2], axis, atol=1e-6) and abs(f["angle"] - math.degrees(angle)) < 1e-4 and f["spread"] < 1e-3
        assert np.allclose(f["axes"] @ f["axes"].T, np.eye(3), atol=1e-9) and np.linalg.det(f["axes"]) > 0
        q, t = any_turn(rng), rng.normal(size=3)
        g = frames.intrinsic_axes(a @ q.T + t, b @ q.T + t, t, up @ q.T + t, across @ q.T)
        assert np.allclose(g["axes"], f["axes"] @ q.T, atol=1e-6)


def test_noise_shows_as_spread():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 3)) * 8
    b = a @ turn(np.array([0.0, 0, 1]), 3.0).T
    spreads = [frames.intrinsic_axes(a, b + rng.normal(size=b.shape) * s, np.zeros(3), np.array([0.0, 0, 9]), np.array([1.0, 0, 0]))["spread"] for s in (0.05, 0.5, 2.0)]
    assert spreads == sorted(spreads) and 0 < spreads[0] < spreads[2]


def test_a_planted_hinge():
    """A turn of one half shows in the pose; a motion of the whole doesn't."""
    rng = np.random.default_rng(6)
    ref = rng.normal(size=(10, 3)) * 6
    same = ref @ any_turn(rng).T + 3
    assert frames.pose_distance(frames.two_way_pose(same, ref, 5), frames.two_way_pose(ref, ref, 5)) < 1e-9
    far = []
    for angle in (0.1, 0.4, 0.9):
        bent = ref.copy()
        q = turn(np.array([0, 1.0, 0]), angle)
        bent[5:] = (bent[5:] - bent[5:].mean(0)) @ q.T + bent[5:].mean(0)
        pose = frames.two_way_pose(bent, ref, 5)
        assert np.allclose(pose[:5], bent[5:], atol=1e-9)  # the second half, seen from the first
        far.append(frames.pose_distance(pose, frames.two_way_pose(ref, ref, 5)))
    assert 0 < far[0] < far[1] < far[2]


def test_split_from_rest_equals_all_pairs(spark):
    """Means over the other members by pairs; the parts add up to the whole distance; a single member has no rest."""
    rng = random.Random(5)
    rows = [(s, rng.choice("AB"), rng.randint(0, 6), rng.randint(0, 2), rng.randint(0, 2), 0, rng.uniform(0.1, 2)) for s in range(13) for _ in range(30)]
    grid = spark.createDataFrame(rows, "structure long, chain string, channel int, ix int, iy int, iz int, mass double").groupBy("structure", "chain", "channel", "ix", "iy", "iz").agg(F.sum("mass").alias("mass"))
    clusters = {s: s % 3 if s < 12 else 9 for s in range(13)}
    members = spark.createDataFrame(list(clusters.items()), "structure long, c long")
    got = {(r["structure"], r["chain"], r["channel"]): r["d2"] for r in voxel.split_from_rest(grid, members, "structure", "c", ["chain", "channel"], 2.0).collect()}
    mass = {}
    for r in grid.collect():
        mass.setdefault(r["structure"], {})[r["chain"], r["channel"], r["ix"], r["iy"], r["iz"]] = r["mass"]

    def d2(a, b, part=None):
        return sum((mass[a].get(v, 0) - mass[b].get(v, 0)) ** 2 for v in {*mass[a], *mass[b]} if part is None or v[:2] == part) / 8

    assert not any(k[0] == 12 for k in got)
    for s in range(12):
        others = [o for o in range(12) if o != s and clusters[o] == clusters[s]]
        parts = {v[:2] for o in (*others, s) for v in mass[o]}
        assert {k[1:] for k in got if k[0] == s} == parts
        for part in parts:
            assert abs(got[(s, *part)] - sum(d2(s, o, part) for o in others) / len(others)) < 1e-9
        assert abs(sum(v for k, v in got.items() if k[0] == s) - sum(d2(s, o) for o in others) / len(others)) < 1e-9


def test_matched_controls(spark):
    """Program features against drawn ones of the same strength; nothing of the program is drawn, and ties share a bin."""
    rng = random.Random(8)
    rows = [(c, f, rng.randint(1, 4) * (1 + f // 10)) for c in range(20) for f in range(60) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "cell long, feature long, v long")
    program, bins, controls = [3, 17, 18, 44, 999], 6, 4
    got = {r["cell"]: r["score"] for r in cells.matched_score(df, "cell", "feature", "v", spark.createDataFrame([(f,) for f in program], "feature long"), bins, controls, "s").collect()}
    sums = {f: sum(v for _, g, v in rows if g == f) for f in {g for _, g, _ in rows}}
    step = max(1, round(len(sums) / (bins - 1)))
    bin_of = {f: (1 + sum(x < sums[f] for x in sums.values())) // step for f in sums}
    inside = [f for f in program if f in sums]
    drawn = []
    for b in {bin_of[f] for f in inside}:
        pool = sorted((f for f in sums if bin_of[f] == b and f not in inside), key=lambda f: (hashlib.md5(f"s|{f}".encode()).hexdigest(), f))
        drawn += pool[:controls]
    for c in range(20):
        of = {f: v for d, f, v in rows if d == c}
        assert abs(got[c] - (sum(of.get(f, 0) for f in inside) / len(inside) - sum(of.get(f, 0) for f in drawn) / len(drawn))) < 1e-9
    none = cells.matched_score(df, "cell", "feature", "v", spark.createDataFrame([(999,)], "feature long"))
    assert {r["score"] for r in none.collect()} == {None}


def plain_gap_cost(a, b, junction):
    """Every place of the gap by itself."""
    cost, front, back = sequence.substitution_cost, (3 if junction else 0), (2 if junction else 0)
    short, long = sorted((a, b), key=len)
    extra, s = len(long) - len(short), len(short)
    if not extra:
        return (3 if junction else 1) * sum(cost(x, y) for x, y in list(zip(a, b, strict=True))[front : max(front, s - back)])
    if junction:
        low, high = 5, s - 5
        while low > high:
            low, high = low - 1, high + 1
        places = range(max(0, low), min(s, high) + 1)
    else:
        places = [max(0, min(6, 3 + (s - 5) // 2))]
    each = [sum(cost(short[i], long[i]) for i in range(front, g)) + sum(cost(short[i], long[i + extra]) for i in range(g, s - back)) for g in places]
    return (3 if junction else 1) * (min(each) + 4 * extra)


def test_loop_distance_equals_every_gap():
    rng = random.Random(3)
    for _ in range(3_000):
        a, b = ("".join(rng.choice("ACDEFGHIKLMNPQRSTVWY.X") for _ in range(rng.randint(0, 22))) for _ in range(2))
        for junction in (True, False):
            assert sequence.loop_distance(a, b, junction) == plain_gap_cost(a, b, junction), (a, b, junction)


def test_one_apart_with_many_copies(spark):
    """Copies of one sequence make no rows among themselves."""
    rows = [(i, "x", "AAAA") for i in range(300)] + [(300, "x", "AAAB"), (301, "y", "AAAB"), (302, "x", "AABB"), (303, "x", ""), (304, "x", None), (305, None, "AAAB")]
    got = sorted(map(tuple, relations.one_apart(spark.createDataFrame(rows, "id long, block string, seq string"), "id", ["block"], "seq").collect()))
    assert got == [(i, 300) for i in range(300)] + [(300, 302)]


def test_near_points_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, *map(float, rng.uniform(0, 20, 3))) for i, k in enumerate(rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "k long, id long, x double, y double, z double")
    got = {(r["a"], r["b"]) for r in relations.near_points(df, df, 4.0, ("k",)).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 4}


def test_dense_raster_with_points_far_away(spark):
    """Points beyond the box reach none of its voxels or a part of them; the two forms agree."""
    rng = random.Random(4)
    rows = [(s, "ALA", a, rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(-12, 12)) for s in range(5) for a in ("N", "CA", "C", "O", "CB")] + [(9, "ALA", "CA", 1e6, 0.0, 0.0), (10, "ALA", "CA", 5.9, -5.9, 0.0)]
    a = voxel.typed(spark.createDataFrame(rows, "structure long, resname string, atom string, x double, y double, z double"))
    one = {tuple(r)[:5]: r["mass"] for r in voxel.raster(a, ["structure"], [-6.0] * 3, [8, 8, 8], 1.3, 1.5).collect()}
    two = {tuple(r)[:5]: r["mass"] for r in voxel.raster_dense(a, "structure", [-6.0] * 3, [8, 8, 8], 1.3, 1.5).collect()}
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one) and not any(k[0] == 9 for k in one)


def test_vector_features_in_their_frames():
    """Each value is unchanged by rigid motion, and equals a structure by structure version; near pairs give no direction."""
    rng = np.random.default_rng(9)
    m, n = 7, 4
    marks, trace = rng.normal(size=(m, 10, 3)) * 5, rng.normal(size=(m, 2 * n, 3)) * 5
    side = trace + rng.normal(size=trace.shape)
    side[:, 0] = trace[:, 0] + 0.1
    template = rng.normal(size=(10, 3)) * 5
    got = frames.vector_features(marks, trace, side, template)
    assert {k: v.shape[1] // 3 for k, v in got.items()} == {"vg": 160, "vc": 80, "vs": 64, "ug": 8, "uc": 8, "us": 8}
    q, t = any_turn(rng), rng.normal(size=3) * 9
    moved = frames.vector_features(*(x @ q.T + t for x in (marks, trace, side)), template)
    assert all(np.allclose(got[k], moved[k], atol=1e-9) for k in got)
    for i in range(m):
        r, _ = frames.kabsch(marks[i][5:], template[5:])
        places = np.concatenate([trace[i][n:], side[i][n:]])
        want = [(x - l) @ r for x in places for l in marks[i][5:]]
        assert np.allclose(got["vc"][i].reshape(-1, 3)[-len(want) :], want, atol=1e-9)
        assert np.allclose(got["ug"][i].reshape(-1, 3)[0], 0) and np.allclose(np.linalg.norm(got["ug"][i].reshape(-1, 3)[1:], axis=1), np.linalg.norm(side[i] - trace[i], axis=1)[1:] >= 0.5)


def test_site_descriptor_with_missing_loops():
    rng = np.random.default_rng(10)
    ref, loops = rng.normal(size=(20, 3)) * 6, [slice(4, 9), slice(9, 10), slice(12, 16)]
    anchors = [0, 1, 2, 3, 16, 17, 18, 19]
    p = ref @ any_turn(rng).T + 4
    whole = frames.site_descriptor(p, anchors, loops, ref, 6)
    assert np.allclose(whole[0], frames.arc_resampled(ref[4:9], 6), atol=1e-9) and np.isnan(whole[1]).all()
    q, t = any_turn(rng), rng.normal(size=3)
    assert np.allclose(frames.site_descriptor(p @ q.T + t, anchors, loops, ref, 6), whole, atol=1e-9, equal_nan=True)
    p[12:16] = np.nan
    p[5], p[0] = np.nan, np.nan
    part = frames.site_descriptor(p, anchors, loops, ref, 6)
    assert np.isnan(part[2]).all() and np.allclose(part[0], frames.arc_resampled(ref[[4, 6, 7, 8]], 6), atol=1e-9)
    p[anchors[2:]] = np.nan
    assert np.isnan(frames.site_descriptor(p, anchors, loops, ref, 6)).all()
