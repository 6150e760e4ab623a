"""What the findings of round 4 asked for."""

import hashlib

import numpy as np
import pyarrow as pa

from tarn.functions.digest import md5_high
from tarn.operators import clustering, distances, labels


def test_cut_stability_has_the_pairs_of_the_wider_cut(spark, sf):
    """The partition at 1.02 times the cut, from a dense matrix of all pairs, not of those within the cut alone."""
    from tarn.plans import QUERIES
    from tarn.plans.analytics import clusters_of
    from tarn.plans.registry import Tables

    t = Tables(spark, sf)
    base, _, cut = clusters_of(t)
    rows = t.embeddings.select("vec_id", "embedding").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in rows], float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    assert ((d > cut) & (d <= 1.02 * cut)).any()
    of = {r["vec_id"]: r["cluster"] for r in base.collect()}

    def ari(factor):
        raw = clustering.agglomerate(d, cut * factor)
        single = {x for x in raw.tolist() if (raw == x).sum() == 1}
        df = spark.createDataFrame([(r["vec_id"], of[r["vec_id"]], -1 if x in single else x) for r, x in zip(rows, raw.tolist(), strict=True)], "_id long, x long, y long")
        return round(clustering.adjusted_rand(df, "x", "y").first()["ari"], 6)

    got = {r["factor"]: r["ari"] for r in QUERIES["N39_cut_stability"](spark, sf).collect()}
    assert got == {0.98: ari(0.98), 1.02: ari(1.02)}


def test_panel_intervals_where_a_column_hardly_varies(spark, tmp_path):
    """Balances whose deviations nearly agree: in some draws a model's distances don't vary, and the interval equals its SQL's."""
    import duckdb

    from tarn.plans import QUERIES, SQL

    con = duckdb.connect()
    con.sql("CREATE TABLE nation AS FROM '/root/testdata/sf0.001/nation.parquet'")
    draw = "('0x' || substr(md5({0} || '|{1}'), 1, 8))::BIGINT"
    con.sql(f"CREATE TABLE customer AS SELECT i AS c_custkey, i % 25 AS c_nationkey, ({draw.format('i', 'x')} % 45000 + {draw.format('i % 25', 'y')} % 200000)::DOUBLE / 100 AS c_acctbal FROM range(0, 1000) r(i)")
    for name in ("nation", "customer"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    want = sorted(con.sql(SQL["N50_panel_intervals"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["N50_panel_intervals"](spark, str(tmp_path)).collect())
    assert any(np.isnan(r[3]) and not np.isnan(r[1]) for r in want)
    assert [str(r) for r in got] == [str(r) for r in want]


def test_ladder_deals_replicates_in_tasks_and_spread(spark, monkeypatch):
    """The same figures from packed replicates, for which no row is shuffled, and from spread ones; nulls, texts and equal ids."""
    rows = [(f"x{i % 95}" if i % 31 else None, i % 8 - 1, "abcde"[i * 13 % 5] if i % 17 else None, None if i % 3 else i % 2) for i in range(400)]
    df = spark.createDataFrame(sorted(set(rows), key=str), "id string, c int, l string, s int").dropDuplicates(["id"]).repartition(3)
    found = lambda: sorted((r["rung"], round(r["mean"], 12), round(r["z"], 9)) for r in labels.null_ladder(df, "id", "c", "l", {"free": [], "s": ["s"]}, 7).collect())
    dealt = []
    monkeypatch.setattr(labels, "_dealt_packed", lambda *a, kept=labels._dealt_packed: [kept(*a), dealt.append(a[2])][0])
    want = found()
    assert sorted(r for share in dealt[0] for r in range(*share)) == list(range(7))
    monkeypatch.setattr(labels, "PACKED", 0)
    monkeypatch.setattr(labels, "RUN", 20)
    assert found() == want and len(dealt) == 1


def test_order_of_digests_that_begin_alike():
    key, stratum = np.array([5, 5, 1, 7, 7, 7], np.uint64), np.array([0, 0, 0, 3, 3, 3])
    whole = {0: b"b", 1: b"a", 2: b"z", 3: b"b", 4: b"b", 5: b"a"}
    assert labels._order(key, stratum, whole.get).tolist() == [2, 1, 0, 5, 3, 4]


def test_md5_high_equals_hashlib():
    for size in (0, 1, 7, 50, 61, 130):
        text = np.random.default_rng(size).integers(48, 58, (size, 20), dtype=np.uint8)
        for end in (b"", b"|donor and lane|199"):
            want = [int(hashlib.md5(text[:, i].tobytes() + end).hexdigest()[:16], 16) for i in range(20)]
            assert md5_high(text, end).tolist() == want


def test_blocks_of_two_tiles_fit_a_cache():
    """Blocks are some rows against SIDE others at most, not against a whole tile, and hold every pair once."""
    kind = pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float32())), ("g", pa.int32())]))
    tile = lambda first: [{"id": first + k, "v": [float(k), 1.0], "g": 0} for k in range(1_300)]
    columns = [pa.array([0, 0]), pa.array([0, 1]), pa.array([tile(0), tile(0)], kind), pa.array([tile(0), tile(1_300)], kind)]
    pairs, largest = 0, 0
    for ia, a, ib, b, same, _, _ in distances._blocks(pa.RecordBatch.from_arrays(columns, ["i", "j", "x", "y"])):
        largest = max(largest, len(b))
        assert not same or ia[0] == ib[0]
        pairs += len(distances._once(same, np.zeros((len(a), len(b)))))
    assert largest == distances.SIDE and pairs == 1_300 * 1_299 // 2 + 1_300 * 1_300


def test_tiles_meet_without_a_shuffle(spark):
    """Every pair of tiles once, read by its task: no row is sent once for each tile."""
    v = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    met = distances._tile_pairs(distances.tiles(df, "id", "v", 64))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert sorted((r["i"], r["j"]) for r in met.select("i", "j").collect()) == [(i, j) for i in range(5) for j in range(i, 5)]


def test_nearest_reads_tiles_and_flushes_what_it_holds(spark, monkeypatch):
    """The k nearest with many ties, where candidates are put in order a few at a time; the tiles meet without a shuffle."""
    monkeypatch.setattr(distances, "HELD", 300)
    monkeypatch.setattr(distances, "FOUND", 40)
    v = np.random.default_rng(8).integers(0, 3, (150, 3)).astype(float)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    df = spark.createDataFrame([(f"n{i:03}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>")
    near = distances.nearest(df, "id", "v", 4, size=64)
    assert "CartesianProduct" in near._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["a"], r["b"], r["d"]) for r in near.collect())
    want = [(f"n{i:03}", f"n{j:03}", x) for i in range(150) for x, j in sorted((d[i, j], j) for j in range(150) if j != i)[:4]]
    assert got == sorted(want)
