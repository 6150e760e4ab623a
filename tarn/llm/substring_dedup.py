"""Operator 5, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash rolls over the bytes of the words of a text. Words at which it is least among their neighbours cut the text
into chunks of variable length, nine words on average, so cuts depend on a few words around them alone and come back
wherever a passage is repeated, whatever was inserted before it. (A cut where masked bits are zero would leave gaps of
random length; the least hash keeps chunks of a passage near their average, and so finds 51 words in 99 % of cases.)
A chunk's digest counts together with that of the chunk after it: two chunks in a row that occur in two documents are
repeated, and overlapping ones join to spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import free_name, stored, table

#: Words of a span at least, words on either side whose hash a cut's may not exceed, and bytes of the rolling hash.
LEAST, NEIGHBOURS, REACH = 20, 4, 16
#: Chunks that a task gathers before it passes them on.
FLUSH = 50_000
#: The gear table: a number for each byte, from a hash, so that all machines agree.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=5) for b in range(256)], np.uint32)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the numbers of the last REACH bytes, each shifted by its distance, added modulo 2 ** 32."""
    g, out = GEAR[data], np.zeros(len(data), np.uint32)
    for k in range(min(REACH, len(data))):
        out[k:] += g[: len(g) - k] << np.uint32(k)
    return out


def cuts(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by blanks, the offset of every word and of the end, and the numbers of the words that chunks start at.

    The first word and the end are cuts too. Any other cut's hash, which covers the REACH bytes from its word's start, isn't
    greater than that of NEIGHBOURS words on either side. In runs of equal words, or of a few in turns, all hashes tie or
    come back: there the cuts keep more than NEIGHBOURS words apart, and chunks are alike wherever the run begins.
    """
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    h = rolling(np.frombuffer(joined, np.uint8))[np.minimum(at[:-1] + REACH - 1, len(joined) - 1)].astype(np.int64)
    padded = np.concatenate([np.full(NEIGHBOURS, 1 << 40), h, np.full(NEIGHBOURS, 1 << 40)])
    least = np.ones(len(h), bool)
    for k in range(1, NEIGHBOURS + 1):
        least &= (h <= padded[NEIGHBOURS - k : len(padded) - NEIGHBOURS - k]) & (h <= padded[NEIGHBOURS + k : len(padded) - NEIGHBOURS + k])
    found = np.nonzero(least)[0]
    if len(found) > 1 and np.diff(found).min() <= NEIGHBOURS:
        kept, last = [], -NEIGHBOURS - 1
        for x in found.tolist():
            if x - last > NEIGHBOURS:
                kept.append(x)
                last = x
        found = np.array(kept, np.int64)
    return joined, at, np.union1d(found, [0, len(words)])


def chunks(text: bytes | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """First word, end word, and two digests (64 and 32 bits) of every two chunks in a row of a UTF-8 text.

    A text of LEAST words or more that is one chunk counts as one pair; shorter texts have none.
    """
    words = (text or b"").split()
    if len(words) < LEAST:
        return [], [], [], []
    joined, at, cut = cuts(words)
    starts, ends = (cut[:-2], cut[2:]) if len(cut) > 2 else (cut[:1], cut[1:])
    pieces = [joined[a:b] for a, b in zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)]
    digest, check = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest
    return starts.tolist(), ends.tolist(), [digest(p) for p in pieces], [check(p) for p in pieces]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, digest, digest2, place``: all pairs of chunks; ``h`` is the text's hash, ``place`` packs the first word
    above the low 24 bits of the pair's words, and the second digest makes a digest of 96 bits with the first."""
    own = _keyed(docs, doc_id, text)
    names = ["doc_id", "h", "digest", "digest2", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, waiting = [], [[], [], []]

            def out() -> pa.RecordBatch:
                digests, checks_, places = (np.concatenate(x) for x in waiting)  # noqa: B023
                at = pa.array(np.repeat([r for r, _ in rows], [n for _, n in rows]))  # noqa: B023
                made = [b.column(0).take(at), b.column(1).take(at), pa.array(digests.view(np.int64)), pa.array(checks_.view(np.int32)), pa.array(places)]  # noqa: B023
                return pa.RecordBatch.from_arrays(made, names)

            size = 0
            for r, t in enumerate(b.column(2).cast(pa.binary())):
                start, end, digest, check = chunks(t.as_py())
                if not start:
                    continue
                place = [a << 24 | min(z - a, (1 << 24) - 1) for a, z in zip(start, end, strict=True)]
                for x, v, kind in zip(waiting, (digest, check, place), (np.uint64, np.uint32, np.int64), strict=True):
                    x.append(np.array(v, kind))
                rows.append((r, len(start)))
                size += len(start)
                if size >= FLUSH:
                    yield out()
                    rows, waiting, size = [], [[], [], []], 0
            if size:
                yield out()

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, h long, digest long, digest2 int, place long")


def shared_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, a, b, first``: the pairs of chunks that two documents hold, and the first document that does.

    ``first`` is a struct ``none, doc_id, h``: ids go by value, rows without one come last, and ``h`` tells texts apart.
    """
    every = stored(chunk_table(docs, doc_id, text))
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    owners = every.groupBy("digest", "digest2").agg(F.min(document).alias("first"), F.max(document).alias("last")).where("first != last")
    shared = stored(owners.select(F.col("digest").alias("of"), F.col("digest2").alias("of2"), "first"))
    start, size = F.shiftright("place", 24), F.col("place").bitwiseAND(F.lit((1 << 24) - 1))
    return every.join(shared, (F.col("digest") == F.col("of")) & (F.col("digest2") == F.col("of2"))).select("doc_id", "h", start.alias("a"), (start + size).alias("b"), "first")


def joined_spans(ranges: DataFrame) -> DataFrame:
    """``doc_id, h, start_word, end_word, first``: the ranges ``a`` to ``b`` of each text that overlap or touch, joined; the
    least ``first``. Spans of fewer than LEAST words are left out."""
    before = Window.partitionBy("doc_id", "h").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc_id", "h").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = ranges.withColumn("opens", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int"))
    numbered = opened.withColumn("span", F.sum("opens").over(so_far))
    spans = numbered.groupBy("doc_id", "h", "span").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("first").alias("first"))
    return spans.where(F.col("end_word") - F.col("start_word") >= LEAST).drop("span")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, n_words, first_doc_id``: the repeated spans of each document that has one.

    A span is a run of overlapping or touching pairs of chunks each of which occurs in another document too, LEAST words
    in all at least; ``first_doc_id`` is the least id that holds one of them. Words are numbered from 0, ends are exclusive.
    Ids may have any type that sorts. Rows equal in id and text are one document; rows of one id with other texts, and rows
    without an id, are documents of their own. Null and short texts have no chunks, an empty table gives an empty result,
    and other columns are ignored. A passage's words before its first cut and after its last one, some 13 of 51, are not in
    the span, and what is repeated within one document alone isn't reported.
    """
    spans = joined_spans(shared_chunks(docs, doc_id, text))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("first.doc_id").alias("first_doc_id"))


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all their columns, without the chunks that an earlier document holds too; what is left stays as it was.

    A pair of chunks is cut from every document but the first that holds it, if the cut makes LEAST words or more. Every
    chunk stays in some document: where it is cut, an earlier document holds it, and so on to the first. Rows equal in id
    and text are cut alike. Null texts and empty tables stay as they are.
    """
    later = shared_chunks(docs, doc_id, text).where(~F.col("first").eqNullSafe(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")))
    per_doc = stored(joined_spans(later).groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cut")))
    names = docs.columns
    marked = free_name("cut", names)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    met = whole.join(per_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left").select("row.*", F.col("cut").alias(marked))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i) for i in range(len(names))]
            texts = []
            for t, cut in zip(columns[at].to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if cut and t is not None:
                    place = [m.span() for m in _WORD.finditer(t)]
                    done, out = 0, []
                    for c in cut:
                        if c["start_word"] < len(place):
                            out.append(t[done : place[c["start_word"]][0]])
                            done = place[min(c["end_word"], len(place)) - 1][1]
                    t = "".join(out) + t[done:]
                texts.append(t)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


SQL = None
