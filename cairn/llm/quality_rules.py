"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts are taken from whole texts. Rules turn them into ratios; how large a ratio may be is learnt, for each stratum
(language) on its own: over labelled good rows, which serve as the holdout since no rule is fitted, each rule walks a fixed
grid of cutoffs from lax to strict and stops at the first for which the exact binomial bound no longer shows that it rejects
fewer than `risk / rules` of good documents, at the level `error / (rules * strata)` (Bonferroni over rules and strata; the
walk along a grid is a fixed-sequence test and costs nothing more). A stratum with too few good rows keeps all its documents.

Null texts count as empty (no words: base_failed). Rows of a doc_id that repeats are joined to one label (the lowest).
Null strata form one stratum. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Rules: a ratio of base counts, and the grid of cutoffs from lax to strict. A document whose ratio exceeds the cutoff is rejected.
GRID = 24
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "shouting": lambda: F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
}


def cutoffs() -> list[float]:
    """The grid, the same for every rule: 0.95 down by a factor to about 0.01."""
    return [round(0.95 * (0.01 / 0.95) ** (i / (GRID - 1)), 6) for i in range(GRID)]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of whole texts. No shuffle.

    Windows of three words are compared by their 64-bit XXH64 within one text.
    """
    low = F.lit("").cast("string") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = base.select(
        "doc_id",
        "stratum",
        F.filter(F.split("text", SPACE, -1), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    at = lambda xs, i: F.get(xs, i)
    windows = F.when(
        F.size("words") >= 3,
        F.array_sort(F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(at(F.col("words"), i), at(F.col("words"), i + 1), at(F.col("words"), i + 2)).alias("h"), i.alias("i")))),
    )
    cut = cut.select("doc_id", "stratum", "n_symbols", "n_upper", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter("windows", lambda x, k: same(at(F.col("windows"), k + 1), x) | same(at(F.col("windows"), k - 1), x))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return cut.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.greatest(F.coalesce(covered, F.lit(0)), F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_upper")


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 8, less the logarithms between; exact to about 12 digits."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        series = series - F.log(x + float(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at rate p, for k up to the mean: the term of k, then those below it, which only get smaller, until they no longer count. k and n are longs."""
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log(1 - p)
    # Twelve deviations below the mean and more, nothing is left; at most so many terms, never k of them.
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(12 * F.sqrt(n * p + 1.0)) + 50).cast("long"))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        at = k - i
        next_ = acc["term"] + F.log(F.greatest(at, F.lit(1.0)) / (n - at + 1)) + math.log((1 - p) / p)
        return F.struct(next_.alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))

    return F.aggregate(steps, start, step, lambda acc: acc["sum"])


def thresholds(counted: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, cut_<rule>...): the strictest cutoff of each rule that keeps its share of the risk; null where none does.

    labels(doc_id, quality): 1 is good. Only counts for each (stratum, rule, grid place) are shuffled.
    """
    grid = cutoffs()
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = counted.where("not base_failed").join(known.where("quality = 1").select("doc_id"), "doc_id")
    ratio = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), value().alias("ratio")) for name, value in RULES.items())))
    # The first grid place whose cutoff the ratio exceeds; GRID where none is exceeded.
    place = F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c >= F.col("ratio")))
    cells = good.select("stratum", ratio.alias("x")).select("stratum", "x.rule", F.col("x.ratio").alias("ratio")).withColumn("place", place).groupBy("stratum", "rule", "place").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"))
    every = sizes.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    # Rejected at a place: the rows that the cutoff there, or a laxer one, rejects.
    lost = every.join(cells, ["stratum", "rule", "place"], "left").withColumn("lost", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("stratum", "rule").orderBy("place")))
    share = risk / len(RULES)
    # Beyond the mean the tail is above a half: no need to sum it.
    tail = F.when(F.col("lost") > F.col("n_good") * share, 1.0).otherwise(binomial_tail(F.col("lost"), F.col("n_good"), share))
    # GRID rows for each stratum and rule: small enough to count the strata in one place.
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(0))))
    tested = lost.withColumn("strata", strata).withColumn("passes", tail <= F.lit(error) / (F.lit(len(RULES)) * F.col("strata")))
    walk = Window.partitionBy("stratum", "rule").orderBy("place")
    chosen = tested.withColumn("upto", F.min(F.col("passes").cast("int")).over(walk)).where("upto = 1").groupBy("stratum", "rule").agg(F.max("place").alias("place"))
    cut = chosen.withColumn("cutoff", F.element_at(F.array(*map(F.lit, grid)), F.col("place") + 1))
    return cut.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons) of every row."""
    counted = counts(docs, id_col, text_col, stratum).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = stored(counted)
    cuts = thresholds(counted, labels, risk, error)
    # Names of the rules that reject, joined by commas.
    reasons = F.concat_ws(",", *(F.when(value() > F.col(f"cut_{name}"), F.lit(name)) for name, value in RULES.items()))
    # One row for each stratum with good labels: languages, a small table; the planner sees its size before it chooses the join.
    return counted.join(cuts, "stratum", "left").withColumn("reasons", reasons).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("reasons") == "")).alias("kept"), "reasons")
