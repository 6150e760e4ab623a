"""Operator 2, mixing sources to target weights: entropy balancing by Newton iterations on the convex dual.

Documents collapse into cells (source, size) before anything else, so one hot source costs no more than another. Each
source's dual variable ``lam`` tilts the rates of its cells, ``rate = min(3, exp(lam * size / mean size))``; Newton steps
inside a bracket, each one grouped pass over the cells, bring the expected words of every source to its target. The
rates are then rounded into whole copies with the error carried from cell to cell. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import free_name, stored, table, words
from tarn.operators.ordered import row_numbers

#: No document is taken more often than this, and no target exceeds so many times its source's size.
MOST = 3
#: Steps after which a source that is not near its target is an error, and the share of it, or the words, that are near.
STEPS, NEAR, WORDS = 200, 1e-6, 0.01
#: Cells of a source, the smallest ones, that carry the rounding error from one to the next.
CARRIED = 1_000
#: Ranks within a cell are counted in parts: so many at least, and one for so many documents of the corpus.
PARTS, PART_ROWS = 1024, 1_000_000


def targets(sources: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a source.

    Weights 1, 2, 3, 1, ... go by code point of the source, null last; they share the sum of all sizes. A target stops at
    MOST times its source's size and the excess is reshared by weight until none is above: each turn is one grouped pass
    that brings two sums to the driver, and the level only rises.
    """
    ranked = row_numbers(sources, [F.col("source").asc_nulls_last()], "rank")
    weighed = stored(ranked.select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight"), (MOST * F.col("source_size")).alias("most")))
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, above = 0.0, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight")
        fixed, weight, now = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)).first()
        if now == above or not weight:
            break
        level, above = float(whole - fixed) / weight, now
    return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def _rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(lam * size / mean, F.lit(2.0))))


def _exact_sum(x: Column) -> Column:
    """A sum of thousandths as decimals: the order of the rows can't change its last digits, so reruns agree."""
    return F.sum(F.round(x * 1000).cast("decimal(38,0)")).cast("double") / 1000


def solve(cells: DataFrame, aims: DataFrame) -> DataFrame:
    """``source, mean, lam``: each source's dual variable, for cells ``source, size, n`` of positive size.

    The expected words rise with ``lam``, so the root lies in a bracket that every step narrows; a Newton step that leaves
    it is replaced by bisection. A source whose target is MOST times its size gets a ``lam`` that fills every document.
    """
    stats = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs"), F.min("size").alias("least"), F.max("size").alias("largest"))
    full = math.log(MOST)
    at = stats.join(aims.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of"))).withColumn("mean", F.col("total") / F.col("docs"))
    at = stored(
        at.select(
            "source", "mean", "target", "total",
            # exp(low * least / mean) is beyond all rates that matter, exp(high * least / mean) is MOST
            (F.lit(-60.0) * F.col("mean") / F.col("least")).alias("low"), (F.lit(full) * F.col("mean") / F.col("least")).alias("high"),
            F.when(F.col("target") >= MOST * F.col("total"), F.lit(full) * F.col("mean") / F.col("least")).otherwise(F.lit(0.0)).alias("lam"),
        )
    )
    for turn in range(STEPS + 1):
        size, rate = F.col("size"), _rate(F.col("lam"), F.col("size"), F.col("mean"))
        sums = (
            cells.join(at.select(F.col("source").alias("of"), "lam", "mean"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy(F.col("source").alias("of"))
            .agg(_exact_sum(F.col("n") * size * rate).alias("got"), _exact_sum(F.when(rate < MOST, F.col("n") * size * size / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        )
        error = F.col("got") - F.col("target")
        step = F.col("lam") - error / F.when(F.col("slope") > 0, F.col("slope"))
        stepped = at.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumn("off", F.abs(error) / F.greatest(F.col("target"), F.lit(1.0)))
        stepped = stepped.withColumn("low", F.when(error <= 0, F.greatest("low", "lam")).otherwise(F.col("low"))).withColumn("high", F.when(error >= 0, F.least("high", "lam")).otherwise(F.col("high")))
        inside = (step > F.col("low")) & (step < F.col("high"))
        done = (F.abs(error) <= F.greatest(NEAR * F.col("target"), F.lit(WORDS))) | (F.col("target") >= MOST * F.col("total"))
        at = stored(stepped.select("source", "mean", "target", "total", "low", "high", F.when(done, F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), done.alias("done"), "off"))
        far = at.where(~F.col("done"))
        if far.isEmpty():
            break
        if turn == STEPS:
            raise RuntimeError(f"no dual after {STEPS} steps: {far.first()}")
    return at.select("source", "mean", "lam")


def cell_copies(cells: DataFrame, duals: DataFrame) -> DataFrame:
    """``source, size, each, extra``: every document of a cell is taken ``each`` times, and ``extra`` of them once more.

    The cells of large sizes are rounded by running sums: the copies so far are those that the rates ask for, rounded
    down. What they miss in words goes to the source's CARRIED smallest cells. Those, from the largest size down, get the
    whole number of copies that brings the source's words so far nearest to what was asked, and pass the rest on. A
    source's cells are its distinct sizes, which number at most the square root of twice its words.
    """
    rated = cells.join(duals.select(F.col("source").alias("of"), "lam", "mean"), F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", _rate(F.col("lam"), F.col("size"), F.col("mean")).alias("rate"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = stored(rated.select("*", upto.alias("upto"), F.row_number().over(Window.partitionBy("source").orderBy("size")).alias("nth")))
    so_far = F.floor("upto")
    copies = so_far - F.coalesce(F.lag(so_far).over(down), F.lit(0))
    large = numbered.select("*", F.least(F.greatest(copies, F.lit(0)), MOST * F.col("n")).alias("copies")).where(F.col("nth") > CARRIED)
    owed = large.groupBy(F.col("source").alias("of")).agg(_exact_sum((F.col("n") * F.col("rate") - F.col("copies")) * F.col("size")).alias("owed"))
    lists = numbered.where(F.col("nth") <= CARRIED).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("cells"))
    rounded = lists.join(owed, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source",
        F.expr(
            f"""aggregate(cells, named_struct('owed', coalesce(owed, 0D), 'out', cast(array() as array<struct<size:bigint,n:bigint,copies:bigint>>)),
            (s, c) -> transform(array(greatest(0L, least({MOST} * c.n, cast(round(c.n * c.rate + s.owed / c.size) as bigint)))),
              k -> named_struct('owed', s.owed + (c.n * c.rate - k) * c.size, 'out', array_append(s.out, named_struct('size', c.size, 'n', c.n, 'copies', k))))[0]).out"""
        ).alias("out"),
    )
    each = rounded.select("source", F.explode("out").alias("c")).select("source", "c.size", "c.n", "c.copies").unionByName(large.select("source", "size", "n", F.col("copies").cast("long").alias("copies")))
    return each.select("source", "size", F.expr("copies div n").alias("each"), F.expr("copies % n").alias("extra"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source_size, source, h, target, copies, taken`` for every row of ``docs``.

    Size is the number of words, 0 for a null or blank text; such a document is taken 0 words. Repeated rows count as
    often as they stand there, ties go by a hash of id and text, and rows equal in both may swap their copies without a
    change in the result. A null source is a source of its own. An empty table gives an empty result. Other columns are
    ignored. ``h`` is the hash of id and text.
    """
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(doc_id, text).alias("h")))
    cells = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    aims = stored(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    filled = cells.where("size > 0")
    copies = stored(cell_copies(filled, solve(filled, aims)))
    parts = max(PARTS, (cells.agg(F.sum("n")).first()[0] or 0) // PART_ROWS)
    own = sized.select("doc_id", "source", "size", "h", F.pmod(F.shiftright("h", 20), F.lit(parts)).alias("part"))
    counted = own.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    in_cell = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        counted.withColumn("before", F.coalesce(F.sum("rows").over(in_cell), F.lit(0)))
        .join(copies.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "each", "extra"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
        .join(aims.select(F.col("source").alias("a_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("a_source")))
        .select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), "source_size", "target", F.coalesce("each", F.lit(0)).alias("each"), (F.coalesce("extra", F.lit(0)) - F.col("before")).alias("quota"))
    )
    placed = own.join(stored(quota), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("part") == F.col("of_part")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = placed.withColumn("copies", F.col("each") + (rank <= F.col("quota")).cast("long"))
    return ranked.select("doc_id", "size", "source_size", "source", "h", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, all their columns, as often as the mix takes them, and ``copy`` from 1 up.

    A table that has a column ``copy`` already keeps it, and the number is called ``copy_``. Null, repeated and empty input
    counts as in ``mix``; rows equal in id, text and source share their copies, so repeated rows are taken alike.
    """
    number = free_name("copy", docs.columns)
    taken = stored(mix(docs, doc_id, text, source).select("doc_id", "source", "h", "copies"))
    key = taken.groupBy(F.col("source").alias("of"), F.col("h").alias("of_h"), F.col("doc_id").alias("of_id")).agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    key = stored(key)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("h"))
    met = whole.join(key, F.col("source").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of_id")))
    if not key.where("rows > 1").isEmpty():  # equal rows share their copies, the first ones one more
        many = stored(met.where("rows > 1")).withColumn("tie", F.monotonically_increasing_id())
        numbered = row_numbers(many, ["of_h", "of", "of_id", "tie"], "at")
        first = numbered.groupBy(F.col("of").alias("f_of"), F.col("of_h").alias("f_h"), F.col("of_id").alias("f_id")).agg(F.min("at").alias("first"))
        same = F.col("of").eqNullSafe(F.col("f_of")) & (F.col("of_h") == F.col("f_h")) & F.col("of_id").eqNullSafe(F.col("f_id"))
        shared = F.expr("all div rows") + (F.col("at") - F.col("first") < F.expr("all % rows")).cast("long")
        met = met.where("rows = 1").select("row", "all").unionByName(numbered.join(stored(first), same).select("row", shared.alias("all")))
    return met.where("all > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("all").cast("int"))).alias("copy")).select("row.*", F.col("copy").alias(number))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = None
