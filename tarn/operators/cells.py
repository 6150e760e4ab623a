"""Expression tables: tag demultiplexing, dispersion, components, program scores."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.numeric import centred_log_ratio
from tarn.operators.ordered import least_rank
from tarn.sources.storage import materialize


def demultiplex(coo: DataFrame, cell: str, tag: str, count: str, quantile: float = 0.99) -> DataFrame:
    """``cell, n_positive, call``: k-means with a group more than tags on the centred log ratios; for each tag the group
    of least mean is negative, its quantile of raw counts is the threshold, and a cell is positive above it. One positive
    tag is a Singlet, none Negative, more a Doublet. Group numbers depend on the seeded start, the rule on their means alone.
    """
    tags = sorted(r[0] for r in coo.select(tag).distinct().collect())
    wide = coo.groupBy(cell).pivot(tag, tags).agg(F.sum(count)).na.fill(0)
    filled = wide.select(cell, F.explode(F.array(*[F.struct(F.lit(g).alias("tag"), F.col(f"`{g}`").alias("v")) for g in tags])).alias("e")).select(cell, "e.tag", "e.v")
    clr = centred_log_ratio(filled, "tag", "v", "clr").groupBy(cell).pivot("tag", tags).agg(F.first("clr"))
    features = clr.select(cell, array_to_vector(F.array(*[F.col(f"`{g}`") for g in tags])).alias("features"))
    model = KMeans(k=len(tags) + 1, seed=1).fit(features)
    grouped = model.transform(features).select(cell, "prediction")
    joined = filled.join(grouped, cell).join(centred_log_ratio(filled, "tag", "v", "clr").select(cell, "tag", "clr"), [cell, "tag"])
    means = joined.groupBy("tag", "prediction").agg(F.avg("clr").alias("m"))
    least = means.groupBy("tag").agg(F.min_by("prediction", F.struct("m", "prediction")).alias("negative"))
    cut = joined.join(least, "tag").where("prediction = negative").groupBy("tag").agg(F.percentile("v", quantile).alias("cut"))
    calls = filled.join(cut, "tag").groupBy(cell).agg(F.count_if(F.col("v") > F.col("cut")).alias("n_positive"))
    return calls.withColumn("call", F.when(F.col("n_positive") == 1, "Singlet").when(F.col("n_positive") == 0, "Negative").otherwise("Doublet"))


def dispersion(df: DataFrame, feature: str, value: str) -> DataFrame:
    return df.groupBy(feature).agg((F.var_pop(value) / F.avg(value)).alias("dispersion"))


def variable_places(df: DataFrame, vector: str, n: int) -> list[int]:
    """The ``n`` places of an array column whose values vary most against their mean size; of equals the lower. One grouped
    pass; what reaches the driver is a number a place."""
    spread = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.var_pop("x") / F.greatest(F.avg(F.abs("x")), F.lit(1e-12))).alias("s"))
    return sorted(r["i"] for r in spread.orderBy(F.desc("s"), "i").limit(n).collect())


def principal_components(df: DataFrame, ident: str, vector: str, k: int, clip: float = 10.0) -> DataFrame:
    """``<ident>, components``: scaled to unit deviation, clipped, and projected on the first ``k`` components."""
    width = df.select(F.max(F.size(vector))).first()[0]
    moments = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    mean, sd = ([float(r[c] or 0) for r in moments] for c in ("m", "s"))
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, sd)).alias("s")), lambda e: F.greatest(F.lit(-clip), F.least(F.lit(clip), (e["x"] - e["m"]) / F.greatest(e["s"], F.lit(1e-12)))))
    rows = df.where(F.size(vector) == width).select(ident, array_to_vector(scaled).alias("f"))
    model = PCA(k=k, inputCol="f", outputCol="c").fit(rows)
    return model.transform(rows).select(ident, vector_to_array("c").alias("components"))


def program_score(df: DataFrame, cell: str, feature: str, value: str, program: list[str]) -> DataFrame:
    """Mean over the program's features less the mean over all others."""
    inside = F.col(feature).isin(*program)
    return df.groupBy(cell).agg((F.avg(F.when(inside, F.col(value))) - F.avg(F.when(~inside, F.col(value)))).alias("score"))


def matched_score(df: DataFrame, cell: str, feature: str, value: str, program: DataFrame, bins: int = 25, controls: int = 50, seed: str = "0") -> DataFrame:
    """``<cell>, score``: a program's mean value in each cell less that of control features that are as strongly expressed.

    ``df`` holds the values that aren't 0; ``program(<feature>)`` the program. Features are ranked by their mean over all
    cells, ties by the least rank, and cut into steps of round(n / (bins - 1)) ranks. From each step that has a feature of
    the program, ``controls`` features outside of it are drawn, the first by md5 of seed and feature; all, where there are
    fewer. Program features that no cell has don't count. A score is null where nothing can be drawn.
    """
    sums = df.groupBy(feature).agg(F.sum(value).alias("_sum"))  # in the order of the means, as all share the number of cells
    n = sums.count()
    step = max(1, round(n / (bins - 1)))
    binned = materialize(least_rank(sums, "_sum", "_rank").select(feature, F.floor(F.col("_rank") / step).alias("_bin")).join(program.select(feature).distinct().withColumn("_in", F.lit(True)), feature, "left"), "bins")
    asked = binned.where("_in").select("_bin").distinct()
    drawn = Window.partitionBy("_bin").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(feature).cast("string"))), feature)
    control = binned.where("_in is null").join(asked, "_bin", "left_semi").withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= controls).select(feature, F.lit(False).alias("_in"))
    used = materialize(binned.where("_in").select(feature, "_in").unionByName(control), "used")
    sizes = used.agg(F.count_if("_in").alias("p"), F.count_if(~F.col("_in")).alias("c")).first()
    if not sizes["p"] or not sizes["c"]:
        return df.select(cell).distinct().withColumn("score", F.lit(None).cast("double"))
    part = lambda inside, size: F.sum(F.when(inside, F.col(value)).otherwise(0.0)) / size
    return df.join(used, feature, "left").groupBy(cell).agg((part(F.coalesce("_in", F.lit(False)), sizes["p"]) - part(F.coalesce(~F.col("_in"), F.lit(False)), sizes["c"])).alias("score"))
