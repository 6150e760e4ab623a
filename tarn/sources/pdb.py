"""Fixed-width structure text as a table of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def atom_lines(atoms: DataFrame) -> DataFrame:
    """``structure, line``: ATOM records of ``structure, chain, resnum, ins, resname, atom, x, y, z``."""
    right = lambda c, n: F.lpad(c, n, " ")
    number = lambda c: F.lpad(F.format_string("%.3f", F.col(c)), 8, " ")
    serial = F.lit("    1")
    line = F.concat(
        F.lit("ATOM  "), serial, F.lit(" "), F.rpad(F.concat(F.lit(" "), "atom"), 4, " "), F.lit(" "), F.rpad("resname", 3, " "), F.lit(" "), F.rpad("chain", 1, " "),
        right(F.col("resnum").cast("string"), 4), F.coalesce(F.when(F.col("ins") != "", F.col("ins")), F.lit(" ")), F.lit("   "), number("x"), number("y"), number("z"), F.lit("  1.00  0.00          "), right(F.substring("atom", 1, 1), 2),
    )
    return atoms.select("structure", line.alias("line"))


def read_atoms(spark: SparkSession, path: str, chains: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Heavy atoms of the chains: ``file, chain, resnum, ins, resname, atom, x, y, z``; alternate places but the first go.

    ``file`` is the path below ``path``; folders below it are read too.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    below = F.regexp_replace(F.col("_metadata.file_path"), f"^.*{path.rstrip('/').rpartition('/')[2]}/", "")
    return parse(lines.select(below.alias("file"), F.col("value").alias("line")), chains)


def parse(lines: DataFrame, chains: tuple[str, ...] = ("A", "B")) -> DataFrame:
    part = lambda a, n: F.substring("line", a, n)
    number = lambda a: F.trim(part(a, 8)).try_cast("double")
    element = F.coalesce(F.when(F.trim(part(77, 2)) != "", F.trim(part(77, 2))), F.substring(F.trim(part(13, 4)), 1, 1))
    keep = (part(1, 6) == "ATOM  ") & part(22, 1).isin(*chains) & part(17, 1).isin(" ", "A") & (element != "H")
    rest = [c for c in lines.columns if c != "line"]
    return lines.where(keep).select(
        *rest, part(22, 1).alias("chain"), F.trim(part(23, 4)).try_cast("int").alias("resnum"), F.trim(part(27, 1)).alias("ins"), F.trim(part(18, 3)).alias("resname"), F.trim(part(13, 4)).alias("atom"),
        number(31).alias("x"), number(39).alias("y"), number(47).alias("z"),
    )
