"""Operator 4, quality rules: base statistics of whole texts and a learned decision list.

Sequential covering learns the list: a rule grows one threshold condition at a time by information gain, is pruned on rows
kept apart, must be nearly pure, and then its rows leave before the next one grows. All counts are grouped aggregations
over binned statistics of labelled rows; the list becomes one ordered Spark conditional. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import hash_sample, stored, table, words

#: Words of a repeated window; a text with fewer words, or with a larger percentage of repeated words, fails at once.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Labelled rows that a fit uses at most, picked by a hash of their id.
MAX_LABELLED = 20_000
#: Shares of the labelled rows at which thresholds stand.
CUTS = [0.005, 0.01, 0.02, *(k / 40 for k in range(1, 40)), 0.98, 0.99, 0.995]

_REPEATED = f"""
CASE WHEN size(array_distinct(q_windows)) = size(q_windows) THEN 0L ELSE
  transform(array(sort_array(transform(q_windows, (h, i) -> named_struct('h', h, 'i', i)))), s ->
    transform(array(sort_array(transform(
        filter(sequence(0, size(s) - 1), k -> coalesce(s[k].h = get(s, k - 1).h, false) OR coalesce(s[k].h = get(s, k + 1).h, false)),
        k -> s[k].i))),
      p -> aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1), x + {WINDOW}) - x)), 0L, (a, b) -> a + b))[0])[0]
END"""


def _left(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are of the class ``[characters]``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a struct ``q`` of the whole text's statistics.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the module's query returns them, and n_chars, n_lines,
    n_upper, n_digits. Windows are compared by 64-bit hashes within one text. Everything is computed within the row, so
    the length of a text costs memory for that text alone and rows are never shuffled. A null text counts as empty.
    """
    own = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("q_text")).withColumn("q_words", words(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.slice("q_words", i, WINDOW))
    n = F.size("q_words")
    first = own.select(
        *keep, "q_text", "q_words", lines.alias("q_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), window)).otherwise(F.array().cast("array<bigint>")).alias("q_windows"),
    )
    # the generator keeps predicates on q from being pushed below it, where they would repeat its work
    return first.select(
        *keep,
        F.explode(F.array(F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
            _left(F.col("q_text"), "#*$%&|<>").alias("n_symbols"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
            F.length("q_text").cast("long").alias("n_chars"),
            F.size("q_lines").cast("long").alias("n_lines"),
            _left(F.col("q_text"), "A-Z").alias("n_upper"),
            _left(F.col("q_text"), "0-9").alias("n_digits"),
        ))).alias("q"),
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def features(q: Column) -> dict[str, Column]:
    """The numbers that rules compare, by name; 0 where a text has no words, lines or characters."""
    share = lambda a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(0.0)
    return {
        "words": q["n_words"].cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_chars"),
        "digit_share": share("n_digits", "n_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules that reject, in their order; each is a conjunction. What none fits is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self, values: dict[str, Column]) -> Column:
        """The text of the first rule that fits, else null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            test = F.lit(True)
            for c in rule:
                test = test & c.column(values)
            out = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def fit(labelled: DataFrame, names: list[str], max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.98, min_support: int = 3) -> DecisionList:
    """Learns a list that finds rows with ``bad`` true, from ``labelled``: a double for each of ``names``, ``bad``, ``apart``.

    Rows with ``apart`` true prune; the others grow. A rule is taken when its rows, grown and kept apart together, are bad
    in ``min_precision`` of all cases and number ``min_support``; a feature whose rule isn't starts no other one. No rows, or one class alone, gives an empty list. What
    reaches the driver is a count for each feature and bin, however many rows there are.
    """
    cuts = labelled.agg(*[F.percentile(x, F.array(*map(F.lit, CUTS))).alias(x) for x in names]).first()
    edges = {x: sorted(set(cuts[x] or [])) for x in names}
    code = lambda x: F.size(F.filter(F.array(*map(F.lit, edges[x])), lambda e: e <= F.col(x))) if edges[x] else F.lit(0)
    rows = stored(labelled.select(F.array(*map(code, names)).alias("codes"), F.col("bad").cast("boolean").alias("bad"), "apart").groupBy("codes", "bad", "apart").agg(F.count("*").alias("n")).coalesce(8))
    place = {x: i for i, x in enumerate(names)}
    test = lambda c: F.col("codes")[place[c[0]]] >= c[2] if c[1] else F.col("codes")[place[c[0]]] < c[2]

    def every(conditions: list) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & test(c)
        return out

    count = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    found, left, barred = [], rows, set()
    while len(found) < max_rules and len(barred) < len(names):
        rule: list = []
        for _ in range(max_conditions):
            seen = left.where(~F.col("apart") & every(rule)).select("bad", "n", F.posexplode("codes").alias("at", "code"))
            bins = [(names[r["at"]], r["code"], r["p"], r["q"]) for r in seen.groupBy("at", "code").agg(count(F.col("bad")).alias("p"), count(~F.col("bad")).alias("q")).collect()]
            p0, n0 = (sum(b[i] for b in bins if b[0] == names[0]) for i in (2, 3))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for x in names if rule else [x for x in names if x not in barred]:
                for k in range(1, len(edges[x]) + 1):
                    p, n = (sum(b[i] for b in bins if b[0] == x and b[1] >= k) for i in (2, 3))
                    for at_least, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        gain = _gain(pp, nn, p0, n0)
                        if gain > best[0] + 1e-12:
                            best = (gain, (x, at_least, k))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        prefixes = [every(rule[: i + 1]) for i in range(len(rule))]
        got = left.agg(*[count(on & (F.col("bad") == bad) & (F.col("apart") == apart)).alias(f"c{i}{int(bad)}{int(apart)}") for i, on in enumerate(prefixes) for bad in (True, False) for apart in (True, False)]).first()
        worth = []
        for i in range(len(rule)):
            p, n = (got[f"c{i}{b}0"] + got[f"c{i}{b}1"] for b in (1, 0))
            pp, pn = got[f"c{i}11"], got[f"c{i}01"]
            worth.append(((pp - pn) / (pp + pn) if pp + pn else -1.0, p >= min_support and p >= min_precision * (p + n), i))
        good = [w for w in worth if w[1]]
        if not good:  # no rule from this feature; another may still start one
            barred.add(rule[0][0])
            continue
        cut = max(good, key=lambda w: (w[0], -w[2]))[2]
        rule = rule[: cut + 1]
        rule = [c for i, c in enumerate(rule) if not any(c[:2] == d[:2] and (d[2] > c[2]) == c[1] and d != c for d in rule[i + 1 :])]
        found.append([Condition(x, at_least, float(edges[x][k - 1])) for x, at_least, k in rule])
        left = left.where(~every(rule))
    return DecisionList(found)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A decision list from the rows of ``docs`` whose id has a label; bad is quality 0.

    Labels without id or quality are left out, an id with several labels counts with the lowest. At most about
    ``max_labelled`` labels are used, picked by a hash of the id; that bound lets the join broadcast them. Texts that the
    base fails teach nothing: no rule needs to find them.
    """
    known = labels.select(F.col("doc_id").alias("of"), "quality").dropna().groupBy("of").agg(F.min("quality").alias("quality"))
    sample = hash_sample(stored(known), "of", max_labelled)
    rows = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(sample), "of")
    stats = statistics(rows, "text", ("of", "quality")).where(~base_failed(F.col("q")))
    values = features(F.col("q"))
    labelled = stats.select(*[v.alias(k) for k, v in values.items()], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("of", F.lit("apart")), F.lit(3)) == 0).alias("apart"))
    return fit(stored(labelled), list(values))


def judge(docs: DataFrame, rules: DecisionList, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``rule`` (that rejects, else null) and ``kept`` for every row.

    Rows stay as they are: repeated ones repeated, a null or blank text has no words and fails the base, an empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    q = F.col("q")
    stats = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    fired = stats.select("doc_id", "q", base_failed(q).alias("base_failed"), rules.fired(features(q)).alias("rule"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return fired.select("doc_id", *[q[x].alias(x) for x in base], "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that neither the base nor a rule rejects.

    A null or blank text fails the base, repeated rows stay or go together, and an empty table stays empty.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"))
    stats = statistics(whole, "text", ("row",))
    good = ~base_failed(F.col("q")) & rules.fired(features(F.col("q"))).isNull()
    return stats.where(good).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


SQL = None
