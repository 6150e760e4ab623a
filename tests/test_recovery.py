"""Archives as sources, the recovery ladder, and clusters against drawn groups."""

import gzip
import hashlib
import io
import random
import tarfile

from pyspark.sql import functions as F

from tarn.operators import panel
from tarn.sources import files
from tarn.streaming import batches


def tar_of(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("a folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    return out.getvalue()


def test_members_of_a_deposit(spark, tmp_path):
    """Archives, compressed or not, of compressed and plain members; single files; damaged and empty ones."""
    rng = random.Random(1)
    big = bytes(rng.randrange(256) for _ in range(1000)) * 3_000
    inside = [("counts/matrix.mtx.gz", gzip.compress(b"%%MatrixMarket matrix\n1 1 1\n")), ("contigs.csv.gz", gzip.compress(b"barcode,chain\nx,TRA\n" * 500)), ("model.pdb", b"ATOM      1  N\n"), ("notes", b"plain words"), ("empty", b""), ("big.bin", b"\x00" + big), ("e.parquet", b"PAR1xx"), ("broken.gz", gzip.compress(b"a,b\n" * 900)[:30])]
    want = {"counts/matrix.mtx.gz": (28, "matrix"), "contigs.csv.gz": (10_000, "table"), "model.pdb": (15, "structure"), "notes": (11, "text"), "empty": (0, "text"), "big.bin": (3_000_001, "binary"), "e.parquet": (6, "parquet"), "broken.gz": (None, "damaged")}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.tar").write_bytes(tar_of(inside))
    (tmp_path / "b.tgz").write_bytes(tar_of(inside, "w:gz"))
    (tmp_path / "c.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n"))
    (tmp_path / "d.json").write_bytes(b'{"a": 1}')
    (tmp_path / "none").write_bytes(b"")
    (tmp_path / "cut.gz").write_bytes(gzip.compress(big)[:5000])
    (tmp_path / "cut.tar").write_bytes(tar_of([("x", b"1,2"), ("y", big)])[:5000])
    got = {}
    for r in files.walk_members(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["member"], r["length"], r["kind"], r["error"] is not None))
    for archive in ("a.tar", "b.tgz"):
        assert sorted(got[archive]) == sorted((n, *want[n], n == "broken.gz") for n in want)
    assert got["c.tsv.gz"] == [(None, 8, "table", False)] and got["d.json"] == [(None, 8, "json", False)] and "none" not in got
    bare = files.members(spark.createDataFrame([("e", bytearray()), ("n", None)], "path string, content binary")).collect()
    assert sorted((r["path"], r["length"], r["kind"]) for r in bare) == [("e", 0, "text"), ("n", 0, "text")]
    assert got["cut.gz"] == [(None, None, "damaged", True)] and got["cut.tar"][0] == ("x", 3, "table", False) and got["cut.tar"][-1][2:] == ("damaged", True)


SCHEMA = "k long, v long"


def rungs():
    return [F.col("v") % 2 == 0, F.col("v") % 3 == 0, F.col("v") % 5 == 0]


def climbed(rows):
    out = {}
    for k, v in rows:
        first = next((i for i, n in enumerate((2, 3, 5)) if v is not None and v % n == 0), None)
        out[k] = (k, v, 2 if first is None else first, "quarantined" if first is None else "done")
    return sorted(out.values(), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("k", "v", "rung", "status").collect()), key=str)


def test_ladder_over_several_batches_and_runs(spark, tmp_path):
    put = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    one, two, three = [(i, i) for i in range(60)], [(i, i) for i in range(60, 75)] + [(200, None)], [(3, 7), (80, 10)]
    put(one, "in")
    put(two, "in")
    run = lambda: batches.recover(spark, f"{tmp_path}/in", "*.parquet", SCHEMA, ["k"], rungs(), root=f"{tmp_path}/state")
    assert rows_of(run()) == climbed(one + two)
    put(three, "in")  # one key comes again with another value
    assert rows_of(run()) == climbed([r for r in one if r[0] != 3] + two + three)


def test_a_stopped_rung_ends_the_same(spark, tmp_path, monkeypatch):
    """Stopped in the second batch, before its manifest; the next run has the same statuses."""
    for rows in ([(i, i) for i in range(40)], [(i, i) for i in range(40, 50)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole, calls = batches.State.merge, []

    def stops(self, batch, number):
        calls.append(number)
        if len(calls) == 2:
            batch.write.partitionBy("k").parquet(f"{self.root}/v{number}")
            raise RuntimeError("stopped")
        whole(self, batch, number)

    monkeypatch.setattr(batches.State, "merge", stops)
    run = lambda: batches.recover(spark, f"{tmp_path}/in", "*.parquet", SCHEMA, ["k"], rungs(), root=f"{tmp_path}/state")
    try:
        run()
        raise AssertionError("it did not stop")
    except Exception as e:  # the stream's own error holds it
        assert "stopped" in str(e)
    monkeypatch.undo()
    assert rows_of(run()) == climbed([(i, i) for i in range(50)])


def test_groups_are_the_first_by_md5(spark, monkeypatch):
    """With a bound that lets too few through, and without any."""
    rows = [(i, float(i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(3)
    for shrink in (1.0, 0.0):
        monkeypatch.setattr(panel.math, "sqrt", lambda x, s=shrink: x**0.5 * s - (0 if s else 30))
        got = {}
        for r in panel.drawn_groups(df, "id", ["v"], [3, 50, 399, 400], 4).collect():
            got.setdefault((r["draw"], r["size"]), []).append(r["id"])
        monkeypatch.undo()
        assert len(got) == 16
        for (d, s), ids in got.items():
            assert sorted(ids) == sorted(sorted(range(400), key=lambda i: hashlib.md5(f"{i}|{d}|{s}".encode()).hexdigest())[:s])
