"""Pre-registered checks: rows that are written even on failure, then stop; roll-ups; stage selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.storage import discard, materialize


class Unmet(RuntimeError):
    """A check failed."""


def known(condition: Column) -> Column:
    """False where ``condition`` compares with a value that isn't known."""
    return F.coalesce(condition, F.lit(False))


def measured(df: DataFrame, step: str, wanted: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """One row a check: ``step, check, value, criterion, passed``, in one pass over ``df``.

    ``wanted`` has an aggregate that is reported, an aggregated condition and what it asks for, by name. A condition on an
    unknown value isn't met.
    """
    rows = [F.struct(F.lit(step).alias("step"), F.lit(name).alias("check"), value.cast("string").alias("value"), F.lit(said).alias("criterion"), known(met).alias("passed")) for name, (value, met, said) in wanted.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def written_or_stopped(checks: DataFrame, path: str) -> DataFrame:
    """``checks`` appended to the table at ``path``; after that, Unmet if one of them failed."""
    checks = materialize(checks, "checks")
    checks.write.mode("append").parquet(path)
    failed = [r["check"] for r in checks.where("not passed").select("check").collect()]
    if failed:
        raise Unmet(f"failed: {failed}")
    return checks


def roll_up(checks: DataFrame, documented: dict[str, list[str]]) -> DataFrame:
    """``step, n, failed, unexpected``: a step is unexpected unless its failing checks are exactly those whose documented
    prefixes are listed."""
    known = [(s, p) for s, ps in documented.items() for p in ps]
    prefixes = checks.sparkSession.createDataFrame(known, "step string, prefix string")
    failing = checks.where("not passed")
    hit = failing.join(prefixes, "step").where(F.col("check").startswith(F.col("prefix")))
    n_hit = hit.select("step", "check").distinct().groupBy("step").agg(F.count("*").alias("hit"))
    n_prefix = hit.select("step", "prefix").distinct().groupBy("step").agg(F.count("*").alias("used"))
    wanted = prefixes.groupBy("step").agg(F.count("*").alias("wanted"))
    steps = checks.groupBy("step").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    for d in (n_hit, n_prefix, wanted):
        steps = steps.join(d, "step", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return steps.select("step", "n", "failed", (~((F.col("failed") == zero("hit")) & (zero("used") == zero("wanted")))).alias("unexpected"))


def select_stages(stages: list[tuple[str, str]], only: list[str] | None = None, start: str | None = None, stop: str | None = None, group: str | None = None) -> list[str]:
    """Names of (name, group) stages to run, in their order; an unknown name raises ValueError."""
    names = [n for n, _ in stages]
    for n in [*(only or []), *([start] if start else []), *([stop] if stop else [])]:
        if n not in names:
            raise ValueError(f"no stage {n}")
    lo = names.index(start) if start else 0
    hi = names.index(stop) if stop else len(names) - 1
    return [n for i, (n, g) in enumerate(stages) if lo <= i <= hi and (not only or n in only) and (group is None or g == group)]


def run_stages(spark: SparkSession, stages: list[tuple[str, list[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Runs (name, inputs, function) stages over each other's written results; a table is deleted after its last reader."""
    last = {x: i for i, (_, inputs, _) in enumerate(stages) for x in inputs}
    tables: dict[str, DataFrame] = {}
    for i, (name, inputs, f) in enumerate(stages):
        tables[name] = materialize(f(*[tables[x] for x in inputs]), name)
        for x in set(inputs):
            if last[x] == i:
                discard(tables.pop(x))
    return tables


def equal_tables(one: DataFrame, other: DataFrame) -> DataFrame:
    """``only_one, only_other``: rows, with repeats, that the other table lacks: a read-back gate."""
    a = one.exceptAll(other).agg(F.count("*").alias("only_one"))
    return a.crossJoin(other.exceptAll(one).agg(F.count("*").alias("only_other")))
