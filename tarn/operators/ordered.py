"""Global order without a single task: ranks and running values that add up partitions first."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.storage import materialize


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """Range-partitioned and sorted by ``order`` and written, with the partition's number in ``_part`` and the place in it in ``_nth``."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row_id", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_part", F.shiftright("_row_id", 33).cast("int")).withColumn("_nth", F.col("_row_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row_id"))


def _with_before(dealt: DataFrame, value: Column, add: Callable[[str], Column], neutral: object) -> DataFrame:
    """``dealt`` with ``_before``: what ``add`` makes of ``value`` in all earlier partitions. The table that is broadcast has
    one row a partition, and so has the window over all of it."""
    parts = dealt.groupBy("_part").agg(value.alias("_value"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_part").alias("_of"), F.coalesce(add("_value").over(earlier), F.lit(neutral)).alias("_before"))
    return dealt.join(F.broadcast(before), F.col("_part") == F.col("_of")).drop("_of")


def row_numbers(df: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """``name``: 0, 1, ... in the total order ``order``."""
    counted = _with_before(_dealt(df, order), F.count("*"), F.sum, 0)
    return counted.withColumn(name, (F.col("_nth") + F.col("_before")).cast("long")).drop("_part", "_nth", "_before")


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with the row, in the total order ``order``."""
    summed = _with_before(_dealt(df, order), F.coalesce(F.sum(value), F.lit(0)), F.sum, 0)
    local = F.sum(value).over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn(name, local + F.col("_before")).drop("_part", "_nth", "_before")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties by their mean: ranks of the distinct values, joined back."""
    distinct = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_sum(distinct, ["_v"], "_n", "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(upto, F.col(value) == F.col("_v"), "left").drop("_v")


def least_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties by the least of theirs."""
    distinct = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_sum(distinct, ["_v"], "_n", "_upto").select("_v", (F.col("_upto") - F.col("_n") + 1).alias(name))
    return df.join(upto, F.col(value) == F.col("_v"), "left").drop("_v")


def percentiles(df: DataFrame, value: str, percents: list[float]) -> list[float | None]:
    """The exact linear percentiles of the values that aren't null, by running counts over the distinct values: no task holds
    them all."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = materialize(running_sum(distinct, ["_v"], "_n", "_upto"), "upto")
    n = upto.agg(F.max("_upto")).first()[0]
    if not n:
        return [None] * len(percents)
    places = [p * (n - 1) for p in percents]
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v"))).cast("double")
    ends = upto.agg(*[at(f(x)) for x in places for f in (math.floor, math.ceil)]).first()
    return [low if low == high else low + (high - low) * (x - math.floor(x)) for x, low, high in zip(places, ends[::2], ends[1::2], strict=True)]


def percentile_in(background: DataFrame, asked: DataFrame, value: str, name: str) -> DataFrame:
    """Percent of ``background`` at most as large as each asked value, by running counts over the distinct values."""
    both = background.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).unionByName(asked.select(F.col(value).alias("_v"), F.lit(0).cast("long").alias("_n"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    upto = running_sum(both, ["_v"], "_n", "_upto")
    total = background.count()
    return asked.join(upto.select("_v", "_upto"), F.col(value) == F.col("_v"), "left").withColumn(name, 100.0 * F.col("_upto") / total).drop("_v", "_upto")


def benjamini_hochberg(df: DataFrame, p: str, name: str, tie: str) -> DataFrame:
    """q = least of p * m / i over this and all larger p; not clipped at 1. Null p have null q and don't count."""
    tested = row_numbers(df.where(F.col(p).isNotNull()), [p, tie], "_i")
    m = tested.count()
    raw = tested.withColumn("_raw", F.col(p) * m / (F.col("_i") + 1))
    dealt = _with_before(_dealt(raw, [F.col("_i").desc()]), F.min("_raw"), F.min, float("inf"))
    local = F.min("_raw").over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    q = dealt.withColumn(name, F.least(local, F.col("_before"))).drop("_part", "_nth", "_before", "_raw", "_i")
    return q.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))
