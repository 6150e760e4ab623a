"""Operator 6, benchmark decontamination: a positional inverted index of the training texts, asked from the rarest terms.

The benchmark's windows are phrases of terms. One pass counts their terms in the corpus, a second one stores the postings
(term, document, position) of each phrase's two rarest terms. Offset-adjusted postings of the rarest term give candidate
starts, the second rarest thins them out, and the postings of all terms in the surviving documents confirm whole phrases:
exact ones, and near ones whose terms stand at most SLACK words from their places. The index holds the terms that
the benchmark asks for; postings of all terms would be several times the texts, and no phrase would ask for them. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import NOT_ALNUM, ascii_lower, stored, table, words

#: Words of a window.
WINDOW = 10
#: Words by which a near match's terms may be off their places, as the rarest term puts them, and positions in a block.
SLACK, BLOCK = 2, 32


def phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``terms(wid, length, at, term)`` of the distinct windows, and ``owners(wid, item_id)``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. Items with a
    null text have none; windows of items without an id count as any other, but nothing is named for them.
    """
    w = items.select(F.col(item_id).alias("item_id"), words(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_ALNUM).alias("w"))
    n = F.size("w")
    cut = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))).when(n > 0, F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    each = w.select("item_id", F.explode(cut).alias("phrase")).withColumn("wid", F.md5(F.array_join("phrase", " ")))
    owners = stored(each.select("wid", "item_id").distinct(), 8)
    terms = each.groupBy("wid").agg(F.first("phrase").alias("phrase")).select("wid", F.size("phrase").alias("length"), F.posexplode("phrase").alias("at", "term"))
    return stored(terms, 8), owners


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, h, pos`` of every place in ``docs(doc_id, h, text)`` where one of ``terms(term)`` stands."""
    placed = docs.select("doc_id", "h", F.posexplode(words(ascii_lower(F.col("text")), NOT_ALNUM)).alias("pos", "term"))
    return placed.join(terms.select("term"), "term", "left_semi")


def _block(pos: Column) -> Column:
    return F.floor(pos / BLOCK).cast("int")


def _probes(at: Column) -> Column:
    """The blocks that hold the positions within SLACK of ``at``: one or two."""
    return F.array_distinct(F.array(_block(at - SLACK), _block(at + SLACK)))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, h, wid, length, start, exact``: every place where all terms of a phrase stand in a row, each once, or near it.

    A near place has each of the phrase's terms within SLACK words of where the phrase, laid with its rarest term on one
    in the text, puts it; exact places are near ones whose terms are all in theirs. Places meet by document, term and
    block of positions, so no term's postings are paired with each other beyond a block.
    """
    same = lambda a, b: a["doc_id"].eqNullSafe(b["of"]) & (a["h"] == b["of_h"])
    vocabulary = stored(terms.select("term").distinct(), 8)
    counts = docs.select(F.explode(words(ascii_lower(F.col("text")), NOT_ALNUM)).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    # a term that the corpus lacks rules its phrases out; else the two rarest terms of each phrase
    ordered = (
        terms.join(stored(counts, 8), "term", "left").groupBy("wid")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("by_rarity"), F.max("length").alias("length"))
        .where("least > 0")
    )
    pivots = stored(ordered.select("wid", "length", F.col("by_rarity")[0].alias("a"), F.get("by_rarity", F.lit(1)).alias("b")), 8)
    index = stored(postings(docs, stored(pivots.select(F.explode(F.array("a.term", "b.term")).alias("term")).where("term is not null").distinct(), 8)))
    rarest = pivots.select(F.col("a.term").alias("term"), F.col("a.at").alias("at"), "wid", "length", "b")
    first = index.join(rarest, "term").select("doc_id", "h", "wid", "length", "b", (F.col("pos") - F.col("at")).alias("start")).where(F.col("start") >= -SLACK).distinct()
    second = index.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), F.col("term").alias("of_term"), F.col("pos").alias("of_pos"), _block(F.col("pos")).alias("of_block"))
    aimed = first.where("b is not null").select("*", (F.col("start") + F.col("b.at")).alias("aim")).select("*", F.explode(_probes(F.col("aim"))).alias("block"))
    both = aimed.join(second, same(aimed, second) & (F.col("b.term") == F.col("of_term")) & (F.col("block") == F.col("of_block")) & (F.abs(F.col("of_pos") - F.col("aim")) <= SLACK), "left_semi")
    columns = ["doc_id", "h", "wid", "length", "start"]
    candidates = stored(both.select(*columns).unionByName(first.where("b is null").select(*columns)).distinct())
    inside = stored(candidates.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).distinct())
    there = docs.join(inside, same(docs, inside), "left_semi")
    all_of = postings(there, vocabulary).distinct().select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "term", "pos", _block(F.col("pos")).alias("of_block"))
    asked = candidates.join(terms.select("wid", "at", "term"), "wid").select(*columns, "at", F.col("term").alias("asked"), (F.col("start") + F.col("at")).alias("aim"))
    asked = asked.select("*", F.explode(_probes(F.col("aim"))).alias("block"))
    met = asked.join(all_of, same(asked, all_of) & (F.col("asked") == F.col("term")) & (F.col("block") == F.col("of_block")) & (F.abs(F.col("pos") - F.col("aim")) <= SLACK))
    placed = met.groupBy(*columns, "at").agg(F.max((F.col("pos") == F.col("aim")).cast("int")).alias("exact"))
    return placed.groupBy(*columns).agg(F.count("*").alias("n"), F.sum("exact").alias("n_exact")).where("n = length").select(*columns, (F.col("n_exact") == F.col("length")).alias("exact"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, a hash of the text and the text: rows equal in id and text are one document to the index."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(own).alias("h"), own.alias("text"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` for every row of ``docs``.

    ``n_near`` counts the distinct windows that occur, exactly or near (``occurrences``). Repeated rows each get the same values, documents of one id and different texts are told apart, a null text has no
    words, and without items nothing is hit. The digest of no items is that of the empty string. Other columns are ignored.
    """
    own = keyed(docs, doc_id, text)
    terms, owners = phrases(items)
    near = stored(occurrences(own, terms))
    found = near.where("exact")
    span = found.groupBy("doc_id", "h", "start").agg(F.max("length").alias("length")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(a.to, x.start))).cast("long").alias("n"), F.greatest(a.to, x.end.cast("long")).alias("to")),
    )
    hits = span.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), covered["n"].alias("n_hit"))
    named = found.select("doc_id", "h", "wid").distinct().join(owners, "wid").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = named.select(F.col("doc_id").alias("n_of"), F.col("h").alias("n_h"), "items")
    windows = near.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.count_distinct("wid").alias("n_near"))
    hits = hits.select(F.col("of").alias("h_of"), F.col("of_h").alias("h_h"), "n_hit")
    both = windows.join(hits, F.col("of").eqNullSafe(F.col("h_of")) & (F.col("of_h") == F.col("h_h")), "left").join(named, F.col("of").eqNullSafe(F.col("n_of")) & (F.col("of_h") == F.col("n_h")), "left").select("of", "of_h", "n_hit", "items", "n_near")
    counted = own.select("doc_id", "h", F.size(words(ascii_lower(F.col("text")), NOT_ALNUM)).cast("long").alias("n_words"))
    return counted.join(stored(both), counted["doc_id"].eqNullSafe(F.col("of")) & (counted["h"] == F.col("of_h")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, in whose text no window of the benchmark occurs exactly.

    Null texts have no words and stay; repeated rows stay or go together; without items or documents nothing goes.
    """
    terms, _ = phrases(items)
    found = stored(occurrences(keyed(docs, doc_id, text), terms).where("exact").select(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).distinct())
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    return whole.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; they are what the SQL gives, and ``n_near`` is tested against brute force."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT length FROM windows),
runs AS (
  SELECT row_no, length, i, array_to_string(w[i:i + length - 1], ' ') AS phrase
  FROM (SELECT row_no, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM d, lengths WHERE len(w) >= length)),
found AS (SELECT row_no, i, r.length, item_id FROM runs r JOIN windows USING (length, phrase)),
hit AS (SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(i, i + length)) AS pos FROM found) GROUP BY row_no),
named AS (SELECT row_no, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_no) LEFT JOIN named USING (row_no)
"""
