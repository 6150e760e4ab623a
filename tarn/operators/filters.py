"""Row filters, flags and the attrition ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as true in text.
TRUE_TEXT = ("true", "1", "t", "yes")


def text_true(name: str) -> Column:
    return F.lower(F.trim(F.col(name).cast("string"))).isin(*TRUE_TEXT)


def where_true_if_there(df: DataFrame, *names: str) -> DataFrame:
    """Keeps rows whose text booleans are true; a column that the table lacks filters nothing."""
    return reduce(lambda d, n: d.where(text_true(n)) if n in d.columns else d, names, df)


def number_or_zero(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(`{name}` AS double)"), F.lit(0.0))


def resolve(df: DataFrame, **wanted: tuple[str, ...]) -> DataFrame:
    """Renames to each key the first column, in any case, of its names; names that aren't there raise ValueError."""
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, choices in wanted.items():
        found = next((have[c.lower()] for c in choices if c.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}: none of {choices}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def chain_of(locus: Column, gene: Column) -> Column:
    """``A`` or ``B`` from a locus, else from the prefix of a gene name, else null."""
    named = lambda c, x: F.upper(c).startswith(f"TR{x}")
    return F.when(named(locus, "A"), "A").when(named(locus, "B"), "B").when(named(gene, "A"), "A").when(named(gene, "B"), "B")


def valid_sequence(seq: Column, junction: Column, shortest: int = 100, longest: int = 145) -> Column:
    return F.length(seq).between(shortest, longest) & ~seq.rlike("[X*]") & junction.rlike("^C.*[FWC]$")


def between_strict(name: str, low=None, high=None, closed: bool = False) -> Column:
    """Thresholds on one column, open or closed; a missing bound doesn't bind."""
    c, out = F.col(name), F.lit(True)
    if low is not None:
        out = out & ((c >= low) if closed else (c > low))
    if high is not None:
        out = out & ((c <= high) if closed else (c < high))
    return out


def attrition(df: DataFrame, steps: list[tuple[str, Column]], entity: str) -> DataFrame:
    """``step, name, n_rows, n_entities`` after each filter, the unfiltered table first, in one pass over ``df``."""
    passed = [F.lit(True)]
    for _, keep in steps:
        passed.append(passed[-1] & F.coalesce(keep, F.lit(False)))
    names = ["all", *[n for n, _ in steps]]
    sums = [f(p).alias(f"{k}{i}") for i, p in enumerate(passed) for k, f in (("r", lambda p: F.count_if(p)), ("e", lambda p: F.count_distinct(F.when(p, F.col(entity)))))]
    lines = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"r{i}").alias("n_rows"), F.col(f"e{i}").alias("n_entities")) for i, n in enumerate(names)])
    return df.agg(*sums).select(F.explode(lines).alias("x")).select("x.*")


def having_all(df: DataFrame, key: str, part: str, parts: list) -> DataFrame:
    """Rows of the keys that have every one of ``parts``: a semi join on the keys' pre-aggregated sets."""
    whole = df.where(F.col(part).isin(*parts)).groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == len(parts))
    return df.join(whole.select(key), key, "left_semi")


def gates(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many rows each gate alone excludes, and how many pass all, as ``gate, n``."""
    every = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests.values()])
    one = df.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()], F.count_if(every).alias("accepted"))
    names = [*tests, "accepted"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*")


def relabel(df: DataFrame, column: str, lookup: DataFrame, old: str, new: str) -> DataFrame:
    """``column`` by the lookup where it has an entry; ``<column>_before`` keeps what was there."""
    there = lookup.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"])
    joined = df.join(there, F.col(column) == F.col("_old"), "left").withColumn(f"{column}_before", F.col(column))
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def in_box(point: list[Column], low: list[float], high: list[float]) -> Column:
    """Half-open on every axis."""
    return reduce(lambda a, b: a & b, [(p >= lo) & (p < hi) for p, lo, hi in zip(point, low, high, strict=True)])


def guarded_name(scores: Column, ambient: Column, most_ambient: float = 0.5, margin: float = 0.02) -> Column:
    """The name with the largest score of ``array<struct<score, name>>``, unless the rows are ambient or it hardly leads."""
    order = F.sort_array(scores, asc=False)
    best, next_ = order[0], F.coalesce(F.get(order, F.lit(1))["score"], F.lit(float("-inf")))
    return F.when(ambient >= most_ambient, "ambient").when((best["score"] > 0) & (best["score"] - next_ > margin), best["name"]).otherwise("unassigned")
