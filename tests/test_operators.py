"""Operators that SQL can't express, against plain versions, and laws that they must keep."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import sequence
from tarn.operators import aggregates, checks, clustering, distances, frames, labels, ordered, panel, relations, voxel


def slow_linkage(d, cut):
    groups = [{i} for i in range(len(d))]
    while len(groups) > 1:
        best = min(((max(d[i][j] for i in a for j in b), min(a), min(b), a, b) for a, b in itertools.combinations(groups, 2)), key=lambda x: (x[0], min(x[1:3]), max(x[1:3])))
        if best[0] > cut:
            break
        groups = [g for g in groups if g is not best[3] and g is not best[4]] + [best[3] | best[4]]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_agglomerate_equals_slow(seed):
    p = np.random.default_rng(seed).normal(size=(30, 3))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for cut in (0.4, 1.0, 2.0):
        raw = clustering.agglomerate(d, cut)
        assert {frozenset(np.nonzero(raw == x)[0].tolist()) for x in set(raw)} == slow_linkage(d.tolist(), cut)


def test_complete_linkage_over_components(spark):
    p = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "id long, v array<double>")
    pairs = distances.all_pairs(df, "id", "v", size=16)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {}
    for r in clustering.complete_linkage(df, pairs, "id", 1.2).collect():
        got.setdefault(r["cluster"] if r["cluster"] >= 0 else ("s", r["id"]), set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == slow_linkage(d.tolist(), 1.2)
    sizes = [len(got[k]) for k in sorted(k for k in got if not isinstance(k, tuple))]
    assert sizes == sorted(sizes, reverse=True)


def test_pairs_and_gram_agree(spark):
    p = np.random.default_rng(2).normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "id long, v array<double>")
    a = {(r["a"], r["b"]): r["d"] for r in distances.all_pairs(df, "id", "v", size=7).collect()}
    b = {(r["a"], r["b"]): r["d"] for r in distances.gram_pairs(df, "id", "v", blocks=3, size=7).collect()}
    assert set(a) == set(b) == set(itertools.combinations(range(40), 2))
    assert all(abs(a[k] - np.linalg.norm(p[k[0]] - p[k[1]])) < 1e-9 and abs(a[k] - b[k]) < 1e-6 for k in a)


def test_kabsch_undoes_rigid_motion():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(12, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    r, t = frames.kabsch(p @ q + 5, p)
    assert frames.deviation((p @ q + 5) @ r + t, p) < 1e-9 and abs(np.linalg.det(r) - 1) < 1e-9
    assert np.linalg.norm(frames.hinge(p @ q, p)) < 1e-6


def atoms(spark, n=3):
    rng = random.Random(4)
    rows = [(s, "ALA", a, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for s in range(n) for a in ("N", "CA", "C", "O", "CB", "XX")]
    return voxel.typed(spark.createDataFrame(rows, "structure long, resname string, atom string, x double, y double, z double"))


def test_raster_forms_agree_and_keep_mass(spark):
    a = atoms(spark)
    low, shape = [-9.0] * 3, [18] * 3
    one = {tuple(r)[:5]: r["mass"] for r in voxel.raster(a, ["structure"], low, shape, 1.0, 1.0).collect()}
    two = {tuple(r)[:5]: r["mass"] for r in voxel.raster_dense(a, "structure", low, shape, 1.0, 1.0).collect()}
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert abs(sum(v for k, v in one.items() if k[1] == 0) - 15) < 1e-9  # five known atoms a structure
    assert a.where("masses is null").count() == 3


def test_grid_distance_nears_the_analytic_one(spark):
    a = atoms(spark, 2)
    pair = spark.createDataFrame([(0, 1)], "a long, b long")
    g = voxel.raster(a, ["structure"], [-12.0] * 3, [48] * 3, 1.5, 0.5)
    d = voxel.grid_d2(g, pair, "structure", 0.5).first()["d2"]
    e = voxel.analytic_d2(a, pair, "structure", 1.5).first()["d2"]
    assert abs(d - e) < 0.02 * e
    parts = voxel.grid_parts(g, pair, "structure", 0.5).agg(F.sum("d2")).first()[0]
    assert abs(parts - d) < 1e-9


def test_channels_follow_the_rules():
    t = {(r, a): m for r, a, m in voxel.channel_rows()}
    assert t["LYS", "NZ"] == [1, 0, 0, 1, 0, 1, 0, 1] and t["PRO", "N"][3] == 0 and t["ASP", "OD1"][6] == 0.5
    assert t["PHE", "CZ"] == [1, 1, 1, 0, 0, 0, 0, 1] and t["HIS", "ND1"][4] == 1 and t["GLY", "OXT"][6] == 1


def test_binomial_tail(spark):
    rows = [(n, k, p) for n in (1, 2, 7, 40) for k in range(n + 1) for p in (0.05, 0.3, 0.9)]
    df = spark.createDataFrame(rows, "n long, k long, p double")
    for r in df.withColumn("t", labels.binomial_tail(F.col("n"), F.col("k"), F.col("p"))).collect():
        want = sum(math.comb(r["n"], i) * r["p"] ** i * (1 - r["p"]) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1))
        assert abs(r["t"] - want) < 1e-9


def test_benjamini_hochberg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.9), (3, None), (4, 0.02), (5, 0.02)], "id int, p double")
    q = {r["id"]: r["q"] for r in ordered.benjamini_hochberg(df, "p", "q", "id").collect()}
    assert q[3] is None and all(abs(q[i] - v) < 1e-12 for i, v in ((1, 0.08 / 3), (4, 0.08 / 3), (5, 0.08 / 3), (2, 0.9)))


def test_row_numbers_and_ranks(spark):
    v = [random.Random(8).randint(0, 20) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v long").repartition(5)
    got = [(r["v"], r["i"]) for r in ordered.row_numbers(df, ["v", "i"]).orderBy("ord").collect()]
    assert got == sorted((x, i) for i, x in enumerate(v))
    rank = {r["i"]: r["r"] for r in ordered.average_rank(df, "v", "r").collect()}
    assert [rank[i] for i in range(200)] == panel.ranks(np.array(v)).tolist()


def test_one_apart_equals_all_pairs(spark):
    rng = random.Random(5)
    s = sorted({"".join(rng.choices("AB", k=rng.choice([4, 5]))) for _ in range(30)})
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(s)], "id long, g int, s string")
    want = {(i, j) for i, j in itertools.combinations(range(len(s)), 2) if len(s[i]) == len(s[j]) and sum(a != b for a, b in zip(s[i], s[j], strict=True)) == 1}
    assert {(r["a"], r["b"]) for r in relations.one_apart(df, "id", ["g"], "s").collect()} == want


def test_near_points(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(-3, 3, (80, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    want = {(i, j) for i in range(80) for j in range(80) if np.linalg.norm(p[i] - p[j]) <= 0.8}
    assert {(r["a"], r["b"]) for r in relations.near_points(df, df, 0.8).collect()} == want


def test_stratum_shuffle_keeps_label_counts(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, "abc"[i % 3]) for i in range(90)], "id long, g int, l string")
    out = labels.stratum_shuffle(df, "id", ["g"], "l", "1")
    count = lambda d: sorted(map(tuple, d.groupBy("g", "l").count().collect()), key=repr)
    assert count(out) == count(df) and out.count() == 90


def test_sequence_distance():
    assert sequence.loop_distance("CASSLG", "CASSLG", True) == 0
    assert sequence.loop_distance("CAAAAAAAAF", "CAAAWAAAAF", True) == 3 * sequence.substitution_cost("A", "W")
    assert sequence.loop_distance("CASSAAAF", "CASSAAF", True) == sequence.loop_distance("CASSAAF", "CASSAAAF", True) >= 12
    assert sequence.substitution_cost("A", "A") == 0 == sequence.substitution_cost("A", ".") and sequence.substitution_cost("A", "W") == 4
    assert sequence.BLOSUM62["W", "W"] == 11 and sequence.BLOSUM62["V", "I"] == sequence.BLOSUM62["I", "V"] == 3
    assert sequence.global_score("ACD", "ACD") == 4 + 9 + 6 and sequence.global_score("AC", "AWC") == 4 - 10 + 9


def test_checks_stop_and_missing(spark, tmp_path):
    df = spark.range(3)
    got = checks.measured(df, "s", {"n": (F.count("*"), F.count("*") == 3, "3"), "unknown": (F.lit(None), F.max("id") != F.lit(None).cast("long"), "")})
    assert [(r["check"], r["value"], r["passed"]) for r in got.collect()] == [("n", "3", True), ("unknown", None, False)]
    with pytest.raises(checks.Unmet):
        checks.written_or_stopped(got, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert checks.select_stages([("a", "x"), ("b", "y"), ("c", "y")], group="y", start="b") == ["b", "c"]
    with pytest.raises(ValueError):
        checks.select_stages([("a", "x")], start="z")


def test_modal_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in aggregates.modal(df, ["k"], "v").collect()] == [(1, "a", 1)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    roots = {r["node"]: r["root"] for r in clustering.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in (100, 101, 102)}) == 1 and len(set(roots.values())) == 2
    assert clustering.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_structure_text_round_trip(spark):
    from tarn.sources import pdb

    rows = [(1, "A", 105, "", "ALA", "CA", 1.25, -3.5, 100.125), (1, "B", 111, "A", "TRP", "CZ2", 0.0, 0.001, -0.001)]
    atoms = spark.createDataFrame(rows, "structure long, chain string, resnum int, ins string, resname string, atom string, x double, y double, z double")
    lines = pdb.atom_lines(atoms)
    other = spark.createDataFrame([(1, r["line"][:16] + "B" + r["line"][17:]) for r in lines.collect()] + [(1, "HETATM"), (1, lines.first()["line"][:76] + " H")], "structure long, line string")
    got = pdb.parse(lines.unionByName(other)).select("structure", "chain", "resnum", "ins", "resname", "atom", "x", "y", "z").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_binning_of_a_repeated_median(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id long, v double")
    got = {r["v"]: r["pct"] for r in ordered.percentile_in(df, spark.createDataFrame([(0.0,), (2.0,), (9.0,), (-1.0,)], "v double"), "v", "pct").collect()}
    assert got == {0.0: 25.0, 2.0: 75.0, 9.0: 100.0, -1.0: 0.0}
