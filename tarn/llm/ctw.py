"""Operator 10, LM scoring: context-tree weighting over bytes, beside an add-one unigram score.

A byte is eight binary decisions, each with its own context tree over the DEPTH bytes before it. A node's estimate mixes
its own Krichevsky-Trofimov estimate with its children's, half and half, so all depths from 0 to DEPTH take part. What is
gathered are the byte grams (context and next byte) and the tokens, so it grows with the corpus, and it stays distributed:

1. Tasks cut their documents into chunks of CHUNK bytes and write them, packed, with the distinct grams and tokens of each.
2. Counts are summed by gram. A node is a long (context bytes, place in the byte's decision tree). Grams meet in buckets
   by the last SPLIT bytes of context, which hold whole subtrees; block probabilities go up to depth SPLIT there, and
   above it as grouped sums over children, 256 at most. Predictions come down the same way.
3. Grams that are 1 / HEAVY of all or more are broadcast, HEAVY at most. Each chunk's other grams, and its tokens, are
   joined with their probabilities and counts, and a chunk is scored with the answers to its own, so a task holds one
   chunk and no more of the model than the chunk needs.

Grams of held-out texts are in the tree with a count of zero. They change no estimate, and what isn't in the training
texts needs no other path.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import stored, table

#: Context bytes (6 at most, which with the next byte and a node fit a long), and the fold that is held out.
DEPTH, FOLDS, HELD_OUT = 5, 7, 2
#: Context bytes of a subtree that one task weighs, and grams of a bucket of such subtrees, about.
SPLIT, BUCKET = 3, 50_000
#: Bytes of text in a chunk, but for a last text that is longer; grams that are sorted at once; bytes of a pack of documents.
CHUNK, BLOCK, PACK = 32_000_000, 1_000_000, 4_000_000
#: A gram is broadcast if it is one in so many or more often.
HEAVY = 1_000_000
#: The byte that ends a text, in training and in scoring; it also stands before its start.
END = 0
#: The token that ends a text. No word is empty.
END_TOKEN = b""
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HALF = math.log(0.5)


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves HELD_OUT modulo FOLDS; a null id has the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def grams(text: bytes, depth: int = DEPTH) -> Iterator[np.ndarray]:
    """Numbers of the byte grams of a lower-cased text framed by END bytes: ``depth`` of context above the next byte."""
    framed = bytes([END]) * depth + text + bytes([END])
    for at in range(0, len(text) + 1, BLOCK):
        b = np.frombuffer(framed[at : at + BLOCK + depth], np.uint8).astype(np.int64)
        n = len(b) - depth
        out = b[:n].copy()
        for k in range(1, depth + 1):
            out <<= 8
            out |= b[k : k + n]
        yield out


class Gathered:
    """Distinct grams and tokens of a chunk with their counts in its training texts."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.tokens: Counter = Counter()
        self.waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.n_waiting = 0
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, low: bytes, apart: bool) -> None:
        found = low.split()
        if apart:
            self.tokens.update(dict.fromkeys([*found, END_TOKEN], 0))
        else:
            self.tokens.update(found)
            self.tokens[END_TOKEN] += 1
        for g in grams(low, self.depth):
            self.waiting[apart].append(g)
            self.n_waiting += len(g)
            if self.n_waiting >= BLOCK:
                self.merge()
        self.size += len(low) + 1

    def merge(self) -> None:
        for apart, arrays in self.waiting.items():
            if arrays:
                values, n = np.unique(np.concatenate(arrays), return_counts=True)
                merged, place = np.unique(np.concatenate([self.grams, values]), return_inverse=True)
                self.counts = np.bincount(place, np.concatenate([self.counts, n * (not apart)]), len(merged)).astype(np.int64)
                self.grams = merged
                arrays.clear()
        self.n_waiting = 0


def _packed(docs: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(docs)
    return out.getvalue().to_pybytes()


def _unpacked(packs: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for p in packs:
        yield from pa.ipc.open_stream(p.as_buffer())


def gather(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``chunk, pack, gram, token, n`` from ``docs(doc_id, text)``: the documents of each chunk in packs, and its distinct
    grams and tokens with their counts. One of the three is set in a row."""
    names, types = ["chunk", "pack", "gram", "token", "n"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, got = TaskContext.get().partitionId() << 32, Gathered(depth)

        def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["chunk"] = pa.array(np.full(size, chunk))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

        def out() -> Iterator[pa.RecordBatch]:
            got.merge()
            yield rows(len(got.grams), gram=pa.array(got.grams), n=pa.array(got.counts))
            yield rows(len(got.tokens), token=pa.array(list(got.tokens), pa.binary()), n=pa.array(list(got.tokens.values()), pa.int64()))

        for b in batches:
            start = size = 0
            for r, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True)):
                low = (t.as_py() or b"").translate(_LOWER)
                got.add(low, held_out(i))
                size += len(low)
                full = got.size >= CHUNK
                if full or size >= PACK or r + 1 == b.num_rows:
                    yield rows(1, pack=pa.array([_packed(b.slice(start, r + 1 - start))], pa.binary()))
                    start, size = r + 1, 0
                if full:
                    yield from out()
                    chunk, got = chunk + 1, Gathered(depth)
        if got.size:
            yield from out()

    return docs.mapInArrow(run, "chunk long, pack binary, gram long, token binary, n long")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, less the product that leads there; x is positive."""
    y = x + 8.0
    steps = x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Natural log of the Krichevsky-Trofimov block probability of so many zeros and ones; exactly 0 for none."""
    z, o = zeros.cast("double"), ones.cast("double")
    return F.when(zeros + ones == 0, 0.0).otherwise(_log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1.0) - math.log(math.pi))


def _log_gammas(x: np.ndarray) -> np.ndarray:
    y, steps = x + 8.0, x.copy()
    for k in range(1, 8):
        steps *= x + k
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


def log_kts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As ``log_kt``, for arrays."""
    own = _log_gammas(zeros + 0.5) + _log_gammas(ones + 0.5) - _log_gammas(zeros + ones + 1.0) - math.log(math.pi)
    return np.where(zeros + ones == 0, 0.0, own)


def _mask(depth: int) -> int:
    """What is left of a node's number after the last ``depth`` bytes alone."""
    return (1 << (8 * depth + 8)) - 1


def subtrees(found: np.ndarray, n: np.ndarray, depth: int, split: int) -> tuple[list[dict[str, np.ndarray]], np.ndarray, np.ndarray]:
    """The levels ``split`` to ``depth`` of the trees that whole subtrees' grams and counts make, and for every gram and
    decision (by decision first) its node in the deepest level and whether it goes to one.

    A level has sorted ``keys``, the estimates ``kt`` of a one, the weights ``w`` of the nodes' own estimates, the block
    probabilities ``log``, the counts ``z`` and ``o``, and ``up``: the nodes' parents in the level above.
    """
    byte = found & 255
    keys = np.concatenate([found - byte + (byte >> (8 - k) | 1 << k) for k in range(8)])
    one = np.concatenate([byte >> (7 - k) & 1 for k in range(8)]).astype(bool)
    names, at = np.unique(keys, return_inverse=True)
    times = np.tile(n.astype(float), 8)
    z, o = np.bincount(at, times * ~one, len(names)), np.bincount(at, times * one, len(names))
    levels = [{"keys": names, "z": z, "o": o, "kt": (o + 0.5) / (z + o + 1), "w": np.ones(len(names)), "log": log_kts(z, o)}]
    for d in range(depth - 1, split - 1, -1):
        child = levels[0]
        names, up = np.unique(child["keys"] & _mask(d), return_inverse=True)
        child["up"] = up
        z, o, below = (np.bincount(up, child[c], len(names)) for c in ("z", "o", "log"))
        own = log_kts(z, o)
        log = _HALF + np.logaddexp(own, below)
        levels.insert(0, {"keys": names, "z": z, "o": o, "kt": (o + 0.5) / (z + o + 1), "w": np.exp(_HALF + own - log), "log": log})
    return levels, at, one


def predictions(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram, n, log10``: the weighted tree's log10 probability of a gram's last byte after its context, for ``counts(gram, n)``."""
    split = min(SPLIT, depth)
    buckets = counts.count() // BUCKET + 1
    context = lambda key: F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * split) - 1))
    in_bucket = lambda key: F.pmod(F.xxhash64(context(F.col(key))), F.lit(buckets)).alias("bucket")
    dealt = counts.select(in_bucket("gram"), "gram", "n")

    def rise(t: pa.Table) -> pa.Table:
        top = subtrees(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth, split)[0][0]
        return pa.table({"key": top["keys"], "z": top["z"].astype(np.int64), "o": top["o"].astype(np.int64), "kt": top["kt"], "w": top["w"], "log": top["log"]})

    levels = {split: stored(dealt.groupBy("bucket").applyInArrow(rise, "key long, z long, o long, kt double, w double, log double"))}
    estimate = ((F.col("o") + 0.5) / (F.col("z") + F.col("o") + 1.0)).alias("kt")
    above = lambda d: F.col("key").bitwiseAND(F.lit(_mask(d)))
    for d in range(split - 1, -1, -1):
        up = levels[d + 1].groupBy(above(d).alias("key")).agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("log").alias("below"))
        own = up.select("key", "z", "o", estimate, "below", log_kt(F.col("z"), F.col("o")).alias("own"))
        both = own.withColumn("log", _HALF + F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))))
        levels[d] = stored(both.select("key", "z", "o", "kt", F.exp(_HALF + F.col("own") - F.col("log")).alias("w"), "log"))
    # a: what the nodes so far say, weighted; r: the weight that is left for those below
    down = levels[0].select("key", (F.col("w") * F.col("kt")).alias("a"), (1 - F.col("w")).alias("r"))
    for d in range(1, split + 1):
        parents = down.select(F.col("key").alias("of"), F.col("a").alias("a0"), F.col("r").alias("r0"))
        down = levels[d].join(parents, above(d - 1) == F.col("of")).select("key", (F.col("a0") + F.col("r0") * F.col("w") * F.col("kt")).alias("a"), (F.col("r0") * (1 - F.col("w"))).alias("r"))

    def fall(t: pa.Table, tops: pa.Table) -> pa.Table:
        found, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        levels, at, one = subtrees(found, n, depth, split)
        order = np.argsort(tops.column("key").to_numpy())
        a, r = (tops.column(c).to_numpy()[order] for c in ("a", "r"))
        for level in levels[1:]:
            a, r = a[level["up"]] + r[level["up"]] * level["w"] * level["kt"], r[level["up"]] * (1 - level["w"])
        p = a[at]
        logs = np.log10(np.where(one, p, 1 - p)).reshape(8, -1).sum(0)
        return pa.table({"gram": found, "n": n, "log10": np.round(logs, 9)})

    tops = down.select(in_bucket("key").alias("of_bucket"), "key", "a", "r")
    return dealt.groupBy("bucket").cogroup(tops.groupBy("of_bucket")).applyInArrow(fall, "gram long, n long, log10 double")


def summed(texts: list[bytes], names: np.ndarray, logs: np.ndarray, depth: int) -> np.ndarray:
    """For each text the sum of ``logs`` over its grams, looked up among the sorted ``names``: each distinct one of a block once."""
    sums, waiting, owners, size = np.zeros(len(texts)), [], [], 0

    def look_up() -> None:
        found, at = np.unique(np.concatenate(waiting), return_inverse=True)
        each = logs[np.searchsorted(names, found)][at]
        starts = np.cumsum([0, *map(len, waiting[:-1])])
        np.add.at(sums, owners, np.add.reduceat(each, starts))

    for i, low in enumerate(texts):
        for g in grams(low, depth):
            waiting.append(g)
            owners.append(i)
            size += len(g)
            if size >= BLOCK:
                look_up()
                waiting, owners, size = [], [], 0
    if waiting:
        look_up()
    return sums


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of ``texts``, null for none, as one array of bytes, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    found, owner = lists.flatten().cast(pa.binary()), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(found), 0)
    return found.filter(full), owner.filter(full).to_numpy()


def _valued(packs: pa.ChunkedArray, answered: pa.Array, logs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of a chunk that are in training texts and log10 of their counts plus one: the ``answered`` ones with their
    ``logs``, and those that are in no training text but this chunk's."""
    values, counts = [], []
    for b in _unpacked(packs):
        learned = pa.array([not held_out(i) for i in b.column(0).to_pylist()], pa.bool_())
        each = split(b.column(1).filter(learned))[0].value_counts()
        values += [each.field("values"), pa.array([END_TOKEN], pa.binary())]
        counts += [each.field("counts").to_numpy(), [pc.sum(learned).as_py() or 0]]
    own = pa.concat_arrays(values).dictionary_encode()
    n = np.bincount(own.indices.to_numpy(), np.concatenate(counts), len(own.dictionary))
    new = np.array(n > 0) & ~pc.is_in(own.dictionary, value_set=answered).to_numpy(zero_copy_only=False)
    return pa.concat_arrays([answered, own.dictionary.filter(pa.array(new))]), np.concatenate([logs, np.log10(n[new] + 1)])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row of ``docs``.

    A null text counts as empty and still has its end. Repeated rows are repeated in training and result. Without a
    training text all counts are 0 and every byte costs its eight bits. An empty table gives an empty result. Other
    columns are ignored. Scores are log10. A text is held whole by one task, together with what its chunk needs.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark, kind = own.sparkSession, dict(own.dtypes)["doc_id"]
    gathered = stored(gather(own, depth))
    asked = gathered.where(F.col("gram").isNotNull()).select("chunk", F.col("gram").alias("asked"), "n")
    learned = stored(predictions(stored(asked.groupBy(F.col("asked").alias("gram")).agg(F.sum("n").alias("n"))), depth))
    n_grams = learned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HEAVY >= max(n_grams, 1)
    heavy = learned.where(often).select("gram", "log10").orderBy("gram").toArrow()
    sent = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy() for c in ("gram", "log10")))
    light = asked.join(F.broadcast(learned.where(often).select("gram")), F.col("asked") == F.col("gram"), "left_anti")
    of_grams = light.select("chunk", "asked").join(learned.where(~often), F.col("asked") == F.col("gram")).select("chunk", "gram", F.lit(None).cast("binary").alias("token"), "log10")

    # a token's row in each of its chunks learns the count in all of them, and one of the rows stands for the token
    each = Window.partitionBy("token")
    tokens = gathered.where(F.col("token").isNotNull()).select("chunk", "token", "n", F.sum("n").over(each).alias("c"), F.min("chunk").over(each).alias("first"))
    tokens = stored(tokens)
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("c") > 0) & (F.col("chunk") == F.col("first")))).first()
    of_tokens = tokens.where("c != n").select("chunk", F.lit(None).cast("long").alias("gram"), "token", F.log10(F.col("c") + 1).alias("log10"))
    level = math.log10(total + distinct + 1)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        often_names, often_logs = sent.value
        known = answers.filter(answers.column("gram").is_valid())
        names = np.concatenate([often_names, known.column("gram").to_numpy()])
        logs = np.concatenate([often_logs, known.column("log10").to_numpy()])
        order = np.argsort(names)
        names, logs = names[order], logs[order]
        del known, order
        rest = answers.filter(answers.column("token").is_valid())
        values, token_logs = _valued(packs.column("pack"), rest.column("token").combine_chunks(), rest.column("log10").to_numpy())
        end = pc.index_in(pa.scalar(END_TOKEN), value_set=values).as_py()
        columns, ids = [], []
        for b in _unpacked(packs.column("pack")):
            ids.append(b.column(0))
            apart = np.array([held_out(i) for i in b.column(0).to_pylist()], bool)
            found, owner = split(b.column(1))
            at = pc.index_in(found, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
            has, rows = at >= 0, b.num_rows
            base = np.bincount(owner[has], token_logs[at[has]], rows) + (0.0 if end is None else token_logs[end])
            n, n_known = np.bincount(owner, minlength=rows) + 1, np.bincount(owner[has], minlength=rows) + (end is not None)
            texts = [(t.as_py() or b"").translate(_LOWER) for t in b.column(1).cast(pa.binary())]
            s = summed(texts, names, logs, depth)
            columns.append((apart, n, n_known, np.full(rows, total), base - n * level, s, -s / math.log10(2) / (np.array([len(t) for t in texts]) + 1)))
        columns = [np.concatenate(c) for c in zip(*columns, strict=True)] or [()] * 7
        kinds = [pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
        out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays([pa.chunked_array(ids), *out], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    packs = gathered.where(F.col("pack").isNotNull()).select(F.col("chunk").alias("own_chunk"), "pack")
    answers = of_grams.unionByName(of_tokens)
    # as many tasks as chunks: what a task reads doesn't grow with the corpus
    n_chunks = max(1, packs.select("own_chunk").distinct().count())
    return packs.repartition(n_chunks, "own_chunk").groupBy("own_chunk").cogroup(answers.repartition(n_chunks, "chunk").groupBy("chunk")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL = None
