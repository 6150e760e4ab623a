"""Readers and writers of tables, file listings and small format rules."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.ordered import row_numbers, running_sum
from tarn.sources.storage import discard, materialize, shared_folder


def round_trip_csv(df: DataFrame, schema: str) -> DataFrame:
    """Writes gzip CSV with a header and scans it with a declared schema; the scan reads the columns that are used."""
    at = f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    names = [c.split()[0] for c in schema.split(",")]
    df.select(*names).write.option("header", True).option("compression", "gzip").csv(at)
    return df.sparkSession.read.schema(schema).option("header", True).csv(at)


def round_trip_json(df: DataFrame, schema: str) -> DataFrame:
    at = f"{shared_folder(df.sparkSession)}/json-{uuid.uuid4().hex}"
    df.write.json(at)
    return df.sparkSession.read.schema(schema).json(at)


def concat_sources(sources: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``cell`` as prefix|id and ``lib`` of each source, with the columns of all; what a source lacks is null."""
    one = lambda prefix, lib, df: df.withColumn("cell", F.concat(F.lit(f"{prefix}|"), F.col("id").cast("string"))).withColumn("lib", F.lit(lib)).drop("id")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p, lib, df) for p, (lib, df) in sources.items()])


#: Kinds of deposited files by name, first match first.
KINDS = [("matrix", r"matrix|\.mtx|\.h5$"), ("contigs", r"contig|vdj"), ("table", r"\.(csv|tsv|txt)(\.gz)?$|\.parquet")]


def walk(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, length, kind`` of the files below ``folder``; contents aren't read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    kind = reduce(lambda out, k: F.when(F.lower("path").rlike(k[1]), k[0]).otherwise(out), reversed(KINDS), F.lit("other"))
    return listed.withColumn("kind", kind)


#: How contents of a kind begin, first match first.
MAGIC = [(b"PAR1", "parquet"), (b"\x89HDF\r\n\x1a\n", "hdf5"), (b"%%MatrixMarket", "matrix"), (b"ATOM  ", "structure"), (b"HEADER", "structure"), (b"{", "json"), (b"[", "json")]
#: Bytes of a member that are looked at to tell its kind, and that are read at a time to learn its length.
HEAD, STEP = 4_096, 1 << 20


def _kind(head: bytes) -> str:
    """By how a content begins; ``table`` if its first line has a separator, ``text`` if it is text, else ``binary``."""
    for begins, kind in MAGIC:
        if head.startswith(begins):
            return kind
    try:
        line = head.decode("utf-8", "ignore" if len(head) >= HEAD else "strict").split("\n", 1)[0]
    except UnicodeDecodeError:
        return "binary"
    return "binary" if "\0" in line else "table" if any(c in line for c in ",\t;") else "text"


def _looked_at(stream) -> tuple[int, str]:
    """Length and kind of a stream's content, read in steps; a first line that is longer than the head is looked at to its end."""
    head = stream.read(HEAD)
    length, kind = len(head), _kind(head)
    within = kind in ("text", "table") and b"\n" not in head
    while part := stream.read(STEP):
        length += len(part)
        if within:
            line, end, _ = part.partition(b"\n")
            if b"\0" in line:
                kind = "binary"
            elif kind == "text" and any(c in line for c in b",\t;"):
                kind = "table"
            within = not end and kind != "binary"
    return length, kind


def _entries(content: bytes) -> Iterator[tuple[str | None, int | None, str, str | None]]:
    """``member, length, kind, error`` of one file: a row a member of a tar archive, else one row. Gzip is opened."""
    packed, whole = content[:2] == b"\x1f\x8b", 0
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz" if packed else "r|") as archive:
            for m in archive:
                if m.isfile():
                    inner = archive.extractfile(m)
                    try:
                        begin = inner.read(2)
                        rest = _Rejoined(begin, inner)
                        found = m.name, *_looked_at(gzip.GzipFile(fileobj=rest) if begin == b"\x1f\x8b" else rest), None
                    except (EOFError, zlib.error, gzip.BadGzipFile) as e:  # the member's own compression
                        found = m.name, None, "damaged", type(e).__name__
                    yield found
                whole += 1
        if whole:
            return
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        if whole:  # an archive up to here
            yield None, None, "damaged", type(e).__name__
            return
    try:
        yield None, *_looked_at(gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)), None
    except (OSError, EOFError, zlib.error) as e:
        yield None, None, "damaged", type(e).__name__


class _Rejoined(io.RawIOBase):
    """A stream with the bytes that were read off its begin put back; forwards only, as archives are read."""

    def __init__(self, begin: bytes, rest):
        self.begin, self.rest = begin, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if n < 0:
            out, self.begin = self.begin, b""
            return out + self.rest.read()
        out, self.begin = self.begin[:n], self.begin[n:]
        return out + (self.rest.read(n - len(out)) if n > len(out) else b"")


def members(deposit: DataFrame) -> DataFrame:
    """``path, member, length, kind, error`` of ``deposit(path, content)``: a row a file within a tar archive, compressed or not, and
    one, with a null member, for every other file.

    Lengths are those of the unpacked contents, kinds go by how they begin. Contents are streamed: a task holds one file as
    it is stored and a step of what is in it. An archive that is cut off gives its whole members and a row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                found = [(path, *e) for e in _entries(bytes(content) if content is not None else b"")]
                yield pd.DataFrame(found, columns=["path", "member", "length", "kind", "error"]).astype({"length": "Int64"})

    return deposit.select("path", "content").mapInPandas(run, "path string, member string, length long, kind string, error string")


def walk_members(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``members`` of all files below ``folder``; Spark leaves out files without bytes, and files of more than 2 GB are
    beyond what it reads as one value."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder))


def archived(df: DataFrame, archive: Column, member: Column, content: Column) -> DataFrame:
    """``path, content``: tar archives of gzip-compressed members, as a deposit has them, members by name. An archive is one row."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for name, data in sorted(zip(rows["member"], rows["content"], strict=True)):
                packed = gzip.compress(bytes(data), mtime=0)
                info = tarfile.TarInfo(name)
                info.size = len(packed)
                archive.addfile(info, io.BytesIO(packed))
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [out.getvalue()]})

    return df.select(archive.alias("path"), member.alias("member"), content.alias("content")).groupBy("path").applyInPandas(pack, "path string, content binary")


def verified(spark: SparkSession, folder: str, expected: dict[str, str]) -> DataFrame:
    """``name, length, state`` for every expected file: ``kept`` if its SHA-256 is the expected one, ``other digest``, or
    ``missing``. Files that aren't expected aren't read."""
    names = spark.createDataFrame(list(expected.items()), "name string, wanted string")
    only = "{" + ",".join(expected) + "}"
    there = spark.read.format("binaryFile").option("pathGlobFilter", only).load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("of"), "length", F.sha2("content", 256).alias("digest"))
    state = F.when(F.col("of").isNull(), "missing").when(F.col("digest") == F.col("wanted"), "kept").otherwise("other digest")
    return names.join(there, F.col("name") == F.col("of"), "left").select("name", "length", state.alias("state"))


def separator(line: Column) -> Column:
    """Of comma, tab and semicolon the one that the header has most often; the first of equals."""
    n = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    return F.when((n(",") >= n("\t")) & (n(",") >= n(";")), ",").when(n("\t") >= n(";"), "\t").otherwise(";")


def best_source(df: DataFrame, key: str, ident: str, score: Column) -> DataFrame:
    """The identifier with the largest score for each key; of equals the least."""
    return df.groupBy(key).agg(F.max_by(ident, F.struct(score, -F.col(ident))).alias("source"))


def pick(df: DataFrame, key: str, exact: Column, name: str) -> DataFrame:
    """For each key the least exact name, else the least name."""
    return df.groupBy(key).agg(F.coalesce(F.min(F.when(exact, F.col(name))), F.min(name)).alias("picked"))


def resolve_path(logical: str, places: dict[str, str]) -> str:
    """The place of the longest prefix of whole path parts, and the rest of the path."""
    for prefix in sorted(places, key=len, reverse=True):
        if logical == prefix or logical.startswith(f"{prefix}/"):
            return places[prefix] + logical[len(prefix) :]
    return logical


def resolved(logical: Column, places: dict[str, str]) -> Column:
    """As ``resolve_path``, of a column."""
    out = logical
    for prefix in sorted(places, key=len):
        inside = (logical == prefix) | logical.startswith(f"{prefix}/")
        out = F.when(inside, F.concat(F.lit(places[prefix]), F.substr(logical, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


#: Rows of a block, the unit that one task follows the chunks through.
BLOCK = 65_536


def _next_starts(df: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """``_key, ord, upto, next``: rows by their place, sizes up to and with the row, and where the chunk after one that begins here
    would begin. That is one place behind the first row whose sum exceeds this row's earlier sum by more than ``most``; how
    many sums are at most that much is a running count over sums and bounds together."""
    lines = row_numbers(df.select(F.col(order).alias("_key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")), ["_key"])
    sums = materialize(running_sum(materialize(lines, "lines"), ["ord"], "_size", "upto"), "sums")
    if not sums.where("_size < 0").isEmpty():
        raise ValueError("sizes of chunks can't be negative")
    both = sums.select(F.col("upto").alias("v"), F.lit(0).alias("asks"), "ord").unionByName(sums.select((F.col("upto") - F.col("_size") + most).alias("v"), F.lit(1).alias("asks"), "ord"))
    counted = running_sum(both.withColumn("one", 1 - F.col("asks")), ["v", "asks", "ord"], "one", "n").where("asks = 1")
    return materialize(sums.join(counted.select("ord", (F.col("n") + 1).alias("next")), "ord"), "next")


def _exits(most: int):
    """Of the rows of a block at which a chunk may begin that follows one of an earlier block: where the chunks from there on leave the block."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ord")
        first, n, nxt, upto, size = int(b["ord"].iloc[0]), len(b), b["next"].to_numpy(), b["upto"].to_numpy(), b["_size"].to_numpy()
        out = nxt.copy()
        for i in range(n - 1, -1, -1):  # later rows are done before those that lead to them
            if nxt[i] < first + n:
                out[i] = out[nxt[i] - first]
        two_before = np.concatenate([np.full(min(n, 2), np.iinfo(np.int64).min), upto[:-2]])
        at = two_before <= upto[0] - size[0] + most
        at[0] = True
        return pd.DataFrame({"entry": first + np.flatnonzero(at), "exit": out[at]})

    return run


def chunks(df: DataFrame, order: str, size: str, most: int, block: int = BLOCK) -> DataFrame:
    """``chunk``: numbers from 0 in the order of the unique ``order``; a chunk ends with the row that takes its size over ``most``.

    Where a chunk ends depends on where the last one did. Every row knows where the next chunk would begin if one began
    there; blocks of rows are followed through by a task each, and what leads from block to block is followed by pointer
    doubling over edge tables, in as many rounds as the logarithm of the number of blocks. Sizes may be 0, null counts as 0,
    negative ones raise.
    """
    lines = _next_starts(df, order, size, most).withColumn("_block", F.floor(F.col("ord") / block))
    spark, n = df.sparkSession, lines.count()
    jumps = materialize(lines.groupBy("_block").applyInPandas(_exits(most), "entry long, exit long").where(F.col("exit") < n), "edges")
    begun = materialize(spark.createDataFrame([(0,)], "entry long"), "begun")
    while not jumps.isEmpty():
        further = begun.join(jumps, "entry").select(F.col("exit").alias("entry"))
        more = materialize(begun.unionByName(further).distinct(), "begun")
        twice = materialize(jumps.select("entry", F.col("exit").alias("via")).join(jumps.withColumnRenamed("entry", "via"), "via").select("entry", "exit"), "edges")
        discard(begun)
        discard(jumps)
        begun, jumps = more, twice
    entries = begun.groupBy(F.floor(F.col("entry") / block).alias("_block")).agg(F.min("entry").alias("entry"))

    def starts(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ord")
        first, nxt, at, out = int(b["ord"].iloc[0]), b["next"].to_numpy(), int(b["entry"].iloc[0]), []
        while at < first + len(nxt):
            out.append(at)
            at = int(nxt[at - first])
        return pd.DataFrame({"ord": out})

    begin = lines.join(entries, "_block").groupBy("_block").applyInPandas(starts, "ord long").withColumn("_begins", F.lit(1))
    marked = lines.select("_key", "ord").join(begin, "ord", "left").select("_key", "ord", F.coalesce("_begins", F.lit(0)).alias("_begins"))
    numbered = running_sum(marked, ["ord"], "_begins", "_chunk").select("_key", (F.col("_chunk") - 1).alias("chunk"))
    return df.join(numbered, F.col(order) == F.col("_key")).drop("_key")


def payloads(df: DataFrame, chunk: str, order: str, value: Column) -> DataFrame:
    """``<chunk>, payload``: base64 of each row's bytes, without line breaks, joined by commas in their order. A chunk's size bounds what one row holds."""
    return df.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.translate(F.base64(value), "\r\n", "").alias("b")))).alias("rows")).select(chunk, F.array_join("rows.b", ",").alias("payload"))


def by_feature(df: DataFrame, feature: str, order: str) -> DataFrame:
    """Writes one folder a feature, sorted by ``order``, and reads them back."""
    at = f"{shared_folder(df.sparkSession)}/features-{uuid.uuid4().hex}"
    df.repartition(feature).sortWithinPartitions(feature, order).write.partitionBy(feature).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in that order; partial maxima shuffle one row a key and task."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("last"))
    return last.select("last.*")


def replace_partitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in the place of all rows of ``old`` with its keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
