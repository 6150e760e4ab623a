"""Numbers and vectors: transforms, unit vectors, quantisation, rotations, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(v: str, least: float = 0.5) -> Column:
    """The vector over its norm; zeros for one shorter than ``least``."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm < least, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def rounded(x: Column, digits: int) -> Column:
    """The double nearest to ``x`` at ``digits`` digits by scaling, halves of the scaled value away from zero, as SQL engines
    round doubles. Zero keeps the sign of ``x``; what scaling would overflow stays as it is."""
    x, step = x.cast("double"), 10.0**digits
    near = F.round(F.abs(x) * step) / step * F.signum(x)
    return F.when(F.abs(near) == float("inf"), x).otherwise(near)


def resample(v: str, n: int) -> Column:
    """Linear resampling of an array at ``n`` places from its first to its last element."""
    last = F.size(v) - 1
    place = lambda i: i * last / F.lit(float(n - 1))
    low = lambda i: F.least(F.floor(place(i)).cast("int"), last - 1)
    at = lambda k: F.get(F.col(v), k).cast("double")
    return F.when(last < 1, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.col(v), F.lit(0)).cast("double"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(low(i)) + (place(i) - low(i)) * (at(low(i) + 1) - at(low(i))))
    )


def rotation_angle(trace: Column) -> Column:
    """Degrees of a rotation matrix of that trace."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def quantised(v: Column, largest: Column) -> Column:
    """1 to 255, half to even."""
    return F.greatest(F.lit(1), F.least(F.lit(255), F.bround(255 * v / largest).cast("int")))


def z_scored(df: DataFrame, v: str, strata: list[str], name: str) -> DataFrame:
    """``name``: ``v`` less its stratum's mean, over the population deviation; the moments are aggregated and joined."""
    moments = df.groupBy(*strata).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return df.join(moments, strata).withColumn(name, (F.col(v) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def centred_log_ratio(df: DataFrame, feature: str, value: str, name: str) -> DataFrame:
    """log1p of the value less the feature's mean log1p over its positive values; the means are joined, not windowed."""
    means = df.where(F.col(value) > 0).groupBy(feature).agg(F.avg(F.log1p(value)).alias("_mean"))
    return df.join(means, feature, "left").withColumn(name, F.log1p(value) - F.coalesce("_mean", F.lit(0.0))).drop("_mean")


def normalised(df: DataFrame, cell: str, value: str, name: str, scale: float = 1e4) -> DataFrame:
    """log1p of the value's share of its cell, times ``scale``."""
    total = df.groupBy(cell).agg(F.sum(value).alias("_total"))
    return df.join(total, cell).withColumn(name, F.log1p(scale * F.col(value) / F.col("_total"))).drop("_total")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    from tarn.operators.ordered import average_rank

    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"))


def partial_spearman(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """Correlation of the ranks less what one control explains of each: the closed form of the residuals' correlation."""
    from tarn.operators.ordered import average_rank

    r = average_rank(average_rank(average_rank(df.select(x, y, control), x, "_x"), y, "_y"), control, "_z")
    c = r.agg(F.corr("_x", "_y").alias("xy"), F.corr("_x", "_z").alias("xz"), F.corr("_y", "_z").alias("yz"))
    return c.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))).alias("rho"))
