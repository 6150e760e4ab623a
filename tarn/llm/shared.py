"""Text columns, bounded samples and materialised tables that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.storage import discard, materialize

__all__ = ["BLANKS", "NOT_ALNUM", "ascii_lower", "discard", "free_name", "hash_sample", "stored", "table", "words"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators as Java character classes: ASCII blanks, and everything in ASCII but digits and small letters.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII takes the byte-wise ``lower``; other texts are translated."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str = BLANKS) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    return materialize(df, "tarn", files)


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of ``key``: the same rows on every run and for every partitioning."""
    n = df.count()
    return df if n <= bound else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it; Spark's names don't differ by case alone."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
