"""Sparse count matrices as Matrix Market folders: ``matrix.mtx``, ``features.tsv`` and ``barcodes.tsv``, gzip-compressed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.ordered import row_numbers
from tarn.sources.storage import materialize, shared_folder

HEADER = "%%MatrixMarket matrix coordinate integer general"


def write(coo: DataFrame, at: str | None = None) -> str:
    """Writes ``coo(cell, feature, feature_type, n)`` and returns the folder. Rows and columns are numbered from 1 in order.

    The three tables are folders of text files, in file order; the first line of the matrix is its header, the second its sizes.
    """
    spark = coo.sparkSession
    at = at or f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    features = materialize(row_numbers(coo.select("feature", "feature_type").distinct(), ["feature", "feature_type"], "row"), "features")
    cells = materialize(row_numbers(coo.select("cell").distinct(), ["cell"], "column"), "cells")
    placed = coo.join(features, ["feature", "feature_type"]).join(cells, "cell")
    entries = placed.select((F.col("row") + 1).alias("r"), (F.col("column") + 1).alias("c"), F.col("n").cast("long").alias("n"))
    sizes = spark.createDataFrame([(-2, -2, HEADER), (-1, -1, f"{features.count()} {cells.count()} {entries.count()}")], "c long, r long, line string")
    lines = sizes.unionByName(entries.select("c", "r", F.concat_ws(" ", "r", "c", "n").alias("line")))
    text = lambda df, name: df.write.option("compression", "gzip").text(f"{at}/{name}")
    text(lines.repartitionByRange("c", "r").sortWithinPartitions("c", "r").select("line"), "matrix.mtx")
    text(features.repartitionByRange("row").sortWithinPartitions("row").select(F.concat_ws("\t", "feature", "feature", "feature_type")), "features.tsv")
    text(cells.repartitionByRange("column").sortWithinPartitions("column").select("cell"), "barcodes.tsv")
    return at


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, block, id``: the lines of a file, or of a folder's files, with what orders them: the file's name, the
    block of it that a task read, and the place in that task. Plain files may be split over tasks."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return materialize(lines, "lines")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line, place``: the lines in file order, numbered from 0."""
    return row_numbers(_lines(spark, path), ["file", "block", "id"], "place").select("line", "place")


def read(spark: SparkSession, at: str) -> DataFrame:
    """``cell, feature, feature_type, n`` of a folder as 10x writes it, in one file a table or several, compressed or not.

    The sizes stand on the first line that is no comment; that line goes by its place, not by what it says. Fewer or more
    entries, features or cells than they state, or an entry outside of them, raise a ValueError.
    """
    part = lambda k: F.split("line", "\t")[k]
    features = materialize(_numbered(spark, f"{at}/features.tsv*").select((F.col("place") + 1).alias("row"), part(1).alias("feature"), part(2).alias("feature_type")), "features")
    cells = materialize(_numbered(spark, f"{at}/barcodes.tsv*").select((F.col("place") + 1).alias("column"), F.col("line").alias("cell")), "cells")
    body = _lines(spark, f"{at}/matrix.mtx*").where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    place = F.struct("file", "block", "id")
    first = body.agg(F.min_by("line", place).alias("sizes"), F.min(place).alias("at")).first()
    if first["sizes"] is None:
        raise ValueError(f"{at} has no line of sizes")
    number = lambda k: F.split(F.trim("line"), "\\s+")[k].cast("long")
    sizes = (F.col("file") == first["at"]["file"]) & (F.col("block") == first["at"]["block"]) & (F.col("id") == first["at"]["id"])
    entries = body.where(~sizes).select(number(0).alias("row"), number(1).alias("column"), number(2).alias("n"))
    stated = tuple(map(int, first["sizes"].split()))
    inside = F.col("row").between(1, stated[0]) & F.col("column").between(1, stated[1])
    seen = entries.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("out")).first()
    found = (features.count(), cells.count(), seen["n"])
    if found != stated or seen["out"]:
        raise ValueError(f"{at} states {stated} features, cells and entries; there are {found}, {seen['out']} of the entries outside")
    return entries.join(features, "row").join(cells, "column").select("cell", "feature", "feature_type", "n")
