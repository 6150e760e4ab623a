"""Group statistics with explicit tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal(df: DataFrame, keys: list[str], value: str, name: str = "modal") -> DataFrame:
    """The commonest value of each key and its count; of equals the least. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias(name), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(value))).alias("_x"))
    return best.select(*keys, "_x.*")


def dominant(df: DataFrame, key: str, label: str, donor: str) -> DataFrame:
    """``label, label_n, frac`` (four digits), the modal donor, the number of donors, and the rows of each key."""
    top = modal(df, [key], label, "label").withColumnRenamed("n", "label_n")
    of = modal(df, [key], donor, "donor").drop("n")
    totals = df.groupBy(key).agg(F.count("*").alias("cells"), F.count(label).alias("labelled"), F.count_distinct(donor).alias("n_donors"))
    joined = totals.join(top, key).join(of, key, "left")
    return joined.select(key, "label", "label_n", F.round(F.col("label_n") / F.col("labelled"), 4).alias("frac"), "donor", "n_donors", "cells")


def representative(df: DataFrame, key: str, ident: str, weight: str) -> DataFrame:
    """The id of largest weight (least id of equals), the weights' sum and the number of rows of each key."""
    return df.groupBy(key).agg(F.max_by(ident, F.struct(F.col(weight), -F.col(ident))).alias("representative"), F.sum(weight).alias("total"), F.count("*").alias("n_rows"))


def joined_set(value: str | Column, separator: str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def synonyms(df: DataFrame, key: str, segments: list[str]) -> DataFrame:
    """``<key>, label``: keys whose modal segments are all equal share one label, their names joined by ``/``."""
    out = df.select(key).distinct()
    for s in segments:
        out = out.join(modal(df, [key], s, f"m_{s}").drop("n"), key, "left")
    tied = [F.coalesce(F.col(f"m_{s}").cast("string"), F.lit("\0")).alias(f"m_{s}") for s in segments]
    out = out.select(key, *tied)
    names = [f"m_{s}" for s in segments]
    return out.join(out.groupBy(*names).agg(joined_set(key, "/").alias("label")), names).select(key, "label")


def totals(df: DataFrame, **measures: Column) -> DataFrame:
    """``name, n`` rows from one aggregation."""
    one = df.agg(*[m.alias(n) for n, m in measures.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for n in measures])).alias("x")).select("x.*")


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("k"))
    return sizes.agg(F.count_if(F.col("k") == 1).alias("singletons"), F.max("k").alias("largest"), F.round(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("expanded_share"))


def pairs_in(k: str = "k") -> Column:
    return F.sum(F.col(k) * (F.col(k) - 1) / 2).cast("long")


def sharing(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """``level, pairs``: pairs that share all columns of a level, by k(k-1)/2, all levels in one pass of grouping sets."""
    columns = sorted({c for cs in levels.values() for c in cs})
    spark = df.sparkSession
    sets = ", ".join(f"({', '.join(cs)})" for cs in levels.values())
    flags = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs) for name, cs in levels.items()}
    grouped = spark.sql(f"SELECT grouping_id({', '.join(columns)}) AS g, count(*) AS k FROM {{rows}} GROUP BY {', '.join(columns)} GROUPING SETS ({sets})", rows=df.select(*columns))
    name = F.create_map(*[F.lit(x) for n, f in flags.items() for x in (f, n)])[F.col("g").cast("int")]
    return grouped.groupBy(name.alias("level")).agg(pairs_in().alias("pairs"))


def fixed_prefix(df: DataFrame, gene: str, seq: str, share: float = 0.95, least: int = 10, from_end: bool = False) -> DataFrame:
    """``<gene>, n, positions, motif``: the leading places at which one symbol has ``share`` of the sequences or more, up
    to the shortest sequence's length. Genes with fewer than ``least`` sequences give no row."""
    s = df.select(gene, (F.reverse(seq) if from_end else F.col(seq)).alias("s"))
    n = s.groupBy(gene).agg(F.count("*").alias("n"), F.min(F.length("s")).alias("shortest")).where(F.col("n") >= least)
    places = s.join(n, gene).where("shortest > 0").select(gene, "n", "s", F.explode(F.sequence(F.lit(1), F.col("shortest"))).alias("at")).select(gene, "n", "at", F.expr("substring(s, at, 1)").alias("c"))
    top = places.groupBy(gene, "n", "at", "c").agg(F.count("*").alias("k")).groupBy(gene, "n", "at").agg(F.min_by(F.struct("c", "k"), F.struct(-F.col("k"), F.col("c"))).alias("x"))
    run = F.min((F.col("x.k") / F.col("n") >= share).cast("int")).over(Window.partitionBy(gene).orderBy("at"))
    led = top.withColumn("ok", run).where("ok = 1").groupBy(gene).agg(F.count("*").alias("positions"), F.sort_array(F.collect_list(F.struct("at", "x.c"))).alias("m"))
    motif = F.array_join("m.c", "")
    return n.join(led, gene, "left").select(gene, "n", F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce(F.reverse(motif) if from_end else motif, F.lit("")).alias("motif"))


def rounded_share(df: DataFrame, key: str) -> DataFrame:
    """Per cent of all rows, one digit."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))
