"""Chunks that restart, Matrix Market folders, and the state of upserts."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.sources import files, matrix
from tarn.streaming import batches


def one_after_another(sizes, most):
    chunk, so_far, out = 0, 0, []
    for s in sizes:
        if so_far > most:
            chunk, so_far = chunk + 1, 0
        so_far += s or 0
        out.append(chunk)
    return out


@pytest.mark.parametrize(("n", "largest", "most", "block"), [(3_000, 40, 100, 64), (500, 3, 400, 16), (300, 0, 5, 32), (200, 900, 10, 7), (1, 5, 10, 4), (64, 10, 0, 8)])
def test_chunks_restart(spark, n, largest, most, block):
    """Chunks within blocks, over many blocks, one a row, and rows without size."""
    rng = random.Random(n)
    sizes = [None if i % 50 == 49 else rng.randint(0, largest) for i in range(n)]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "id long, size long").repartition(5)
    got = [r["chunk"] for r in files.chunks(df, "id", "size", most, block).orderBy("id").collect()]
    assert got == one_after_another(sizes, most)


def test_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select("id", (F.xxhash64("id") % 50 + 50).alias("size"))
    sizes = [r["size"] for r in df.collect()]
    got = np.array([r["chunk"] for r in files.chunks(df, "id", "size", 40_000).select("id", "chunk").orderBy("id").collect()])
    assert (got == np.array(one_after_another(sizes, 40_000))).all()


def test_no_rows_and_negative_sizes(spark):
    assert files.chunks(spark.createDataFrame([], "id long, size long"), "id", "size", 5).count() == 0
    with pytest.raises(ValueError, match="negative"):
        files.chunks(spark.createDataFrame([(1, -1)], "id long, size long"), "id", "size", 5)


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def entries(df):
    return sorted(tuple(r) for r in df.select("cell", "feature", "feature_type", "n").collect())


@pytest.mark.parametrize("n", [1, 20_000])
def test_matrix_comes_back(spark, no_coalescing, n):
    """One entry, which reads as the line of sizes does, and many part files."""
    coo = spark.range(n).select(F.concat(F.lit("c"), (F.col("id") % 997).cast("string")).alias("cell"), F.concat(F.lit("f"), F.floor(F.col("id") / 997).cast("string")).alias("feature"), F.lit("Gene Expression").alias("feature_type"), (F.col("id") % 7 + 1).alias("n"))
    assert entries(matrix.read(spark, matrix.write(coo))) == entries(coo)


def test_plain_and_compressed_files(spark, tmp_path):
    lines = {"features.tsv": "g1\tA\tGene Expression\ng2\tB\tAntibody Capture\n", "barcodes.tsv": "x-1\nx-2\nx-3\n", "matrix.mtx": "%%MatrixMarket matrix coordinate integer general\n% a comment\n2 3 3\n2 3 3\n1 1 5\n2 2 1\n"}
    want = [("x-1", "A", "Gene Expression", 5), ("x-2", "B", "Antibody Capture", 1), ("x-3", "B", "Antibody Capture", 3)]
    for folder, write in (("plain", lambda p, t: p.write_text(t)), ("packed", lambda p, t: p.with_name(f"{p.name}.gz").write_bytes(gzip.compress(t.encode())))):
        (tmp_path / folder).mkdir()
        for name, text in lines.items():
            write(tmp_path / folder / name, text)
        assert entries(matrix.read(spark, f"file://{tmp_path}/{folder}")) == want


def test_split_files_keep_their_order(spark, tmp_path):
    """A plain file that several tasks read."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    n = 5_000
    (tmp_path / "features.tsv").write_text("".join(f"g{i}\tG{i}\tGene Expression\n" for i in range(n)))
    (tmp_path / "barcodes.tsv").write_text("x\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n" + f"{n} 1 {n}\n" + "".join(f"{i + 1} 1 {i + 1}\n" for i in range(n)))
    got = matrix.read(spark, f"file://{tmp_path}").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["feature"], r["n"]) for r in got) == sorted((f"G{i}", i + 1) for i in range(n))


@pytest.mark.parametrize("body", ["2 1 1\n1 1 1\n", "1 1 2\n1 1 1\n", "1 1 1\n2 1 1\n", ""])
def test_wrong_sizes_raise(spark, tmp_path, body):
    (tmp_path / "features.tsv").write_text("g\tG\tGene Expression\n")
    (tmp_path / "barcodes.tsv").write_text("x\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n" + body)
    with pytest.raises(ValueError, match=r"states|sizes"):
        matrix.read(spark, f"file://{tmp_path}")


SCHEMA = "k long, at long, v string"


def last_of(rows):
    out = {}
    for k, at, v in rows:
        if k not in out or at > out[k][1]:
            out[k] = (k, at, v)
    return sorted(out.values())


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    """The second call finds state and checkpoint by the folder and reads the new files alone."""
    rng, rows = random.Random(1), []

    def add(n):
        new = [(rng.randint(0, 99), len(rows) + i, f"v{len(rows) + i}") for i in range(n)]
        rows.extend(new)
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda: batches.upsert(spark, f"{tmp_path}/in", "*.parquet", SCHEMA, ["k"], ["at"], root=f"{tmp_path}/state")
    add(200)
    assert sorted(map(tuple, run().collect())) == last_of(rows)
    assert sorted(map(tuple, run().collect())) == last_of(rows)  # nothing new
    add(150)
    add(3)
    assert sorted(map(tuple, run().collect())) == last_of(rows)


def test_a_stopped_batch_runs_again(spark, tmp_path, monkeypatch):
    """Stopped after its data and before its manifest: the state is the one before, then the whole one."""
    first, second = [(i, i, "a") for i in range(50)], [(i, 100 + i, "b") for i in range(40, 60)]
    state = batches.State(spark, f"{tmp_path}/s", ["k"], ["at"], 4)
    state.merge(spark.createDataFrame(first, SCHEMA), 0)
    monkeypatch.setattr(batches.State, "_forget", lambda *_: None)
    create = spark.createDataFrame
    batch = create(second, SCHEMA)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        state.merge(batch, 1)
    monkeypatch.undo()
    assert sorted(map(tuple, batches.State(spark, f"{tmp_path}/s", ["k"], ["at"], 4).read(SCHEMA).collect())) == first
    for _ in range(2):  # again, and again after it was whole
        state.merge(batch, 1)
        assert sorted(map(tuple, state.read(SCHEMA).collect())) == last_of(first + second)


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    state = batches.State(spark, f"{tmp_path}/s", ["k"], ["at"], 16)
    state.merge(spark.createDataFrame([(i, 0, "a") for i in range(100)], SCHEMA), 0)
    for n in (1, 2, 3):
        state.merge(spark.createDataFrame([(5, n, "b")], SCHEMA), n)
    versions = state.manifest()
    assert sorted(versions.values()).count(3) == 1 and set(versions.values()) == {0, 3}
    bucket = next(b for b, v in versions.items() if v == 3)
    assert sorted(p.parent.name for p in tmp_path.glob(f"s/v*/_bucket={bucket}")) == ["v2", "v3"]  # this and what it began with


def test_settings_by_row(spark):
    from tarn import config

    docs = [None, "{}", '{"cells": {"min_umis": 7, "separator": null}}', '{"cells": {"umis": 1}, "x": {"y": 2}, "labels": {"reps": 5, "q": {}}}', '{"cells": 3}', "no json", '{"cells": {"min_umis": "many"}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, doc string")
    got = {r["id"]: r for r in df.select("id", config.settings(F.col("doc")).alias("s"), config.unknown(F.col("doc")).alias("u")).collect()}
    assert got[0]["s"].asDict(True) == config.DEFAULTS == got[1]["s"].asDict(True) == got[5]["s"].asDict(True) == got[6]["s"].asDict(True)
    assert got[2]["s"].asDict(True) == config.merge(config.DEFAULTS, {"cells": {"min_umis": 7.0}}) and got[3]["s"]["labels"]["reps"] == 5
    assert sorted(got[3]["u"]) == ["cells.umis", "labels.q", "x"] and [got[i]["u"] for i in (0, 1, 2, 4, 5)] == [[]] * 5
