"""Evaluation: recall, sweeps, thresholds, AUC, paired comparison, percentiles, capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs of recall; the grid of weights that is swept (dense stays 1.0).
KS = (1, 3, 5, 10)
SPARSE_GRID, SUMMARY_GRID = (1.0, 1.3, 1.6), (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)


#: Parts in which distinct scores are ranked.
AUC_PARTS = 64


def recall_at_k(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(category, k, items, any_rate): share of items with a target among the first k, by category, and 'TOTAL'.

    hits(item, category, rank, is_target): ranked results; an item without results counts as a miss if it has a row with null rank.
    """
    each = hits.groupBy("item", "category").agg(*(F.max(F.coalesce((F.col("rank") <= k) & F.col("is_target"), F.lit(False)).cast("int")).alias(f"k{k}") for k in ks))
    long = each.select("category", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("hit")) for k in ks))).alias("x")).select("category", "x.k", "x.hit")
    rolled = long.groupingSets([[F.col("k"), F.col("category")], [F.col("k")]], F.col("k"), F.col("category")).agg(F.count("*").alias("items"), F.round(F.avg("hit"), 6).alias("any_rate"), F.grouping("category").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "k", "items", "any_rate")


def band(score: Column, count: Column, low: float | Column, high: float | Column) -> Column:
    """none, mid or high, of a comparable score."""
    return F.when((count == 0) | (score < low), "none").when(score < high, "mid").otherwise("high")


def band_counts(rows: DataFrame, low: Column, high: Column) -> list[Column]:
    """Counts of outcomes of a gate over rows(score, present)."""
    s, p = F.col("score"), F.col("present")
    return [
        F.count_if(s >= low).alias("delivered"),
        F.count_if((s >= high) & ~p).alias("fabrications"),
        F.count_if((s >= low) & (s < high) & p).alias("hedged_present"),
        F.count_if((s >= low) & (s < high) & ~p).alias("hedged_absent"),
        F.count_if((s < low) & p).alias("lost"),
        F.count_if((s < low) & ~p).alias("rejected"),
    ]


def threshold_sweep(rows: DataFrame, lows: list[float], highs: list[float]) -> DataFrame:
    """Outcome counts of every pair low < high of a fixed grid: each row meets the grid as an array, and is summed on the map side."""
    grid = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a in lows for b in highs if a < b))
    each = rows.select("score", "present", F.explode(grid).alias("g")).select("score", "present", "g.low", "g.high")
    return each.groupBy("low", "high").agg(*band_counts(each, F.col("low"), F.col("high")))


def auc(rows: DataFrame) -> DataFrame:
    """(positives, negatives, auc) of rows(score, present): the rank sum, ties counting half.

    Counted by distinct score; scores are dealt to parts at approximate quantiles, and what lies below a score is what earlier
    parts have, plus what its own part has below it. One row for each part is all that stands in one place.
    """
    # A row a distinct score, read three times: the scores are computed once.
    by = rows.groupBy("score").agg(F.count_if("present").alias("p"), F.count_if(~F.col("present")).alias("n")).persist()
    cuts = by.agg(F.percentile_approx("score", [i / AUC_PARTS for i in range(1, AUC_PARTS)])).first()[0] or []
    dealt = by.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("score"))))
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("m"), F.min("score").alias("low"))
    earlier = sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row a part
    inside = dealt.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = inside.join(F.broadcast(earlier), "part").withColumn("below", F.col("earlier") + F.col("inside"))
    out = below.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("s"))
    return out.select("positives", "negatives", F.round(F.col("s") / (F.col("positives") * F.col("negatives")), 9).alias("auc"))


def class_overlap(rows: DataFrame) -> DataFrame:
    """Least, median and largest score of either class, and how many lie where the classes overlap."""
    # A row a class and distinct score, read three times: the scores are computed once.
    by = rows.groupBy("present", "score").agg(F.count("*").alias("m")).persist()
    stats = by.groupBy("present").agg(F.sum("m").alias("n"), F.min("score").alias("low"), F.percentile("score", 0.5, F.col("m")).alias("mid"), F.max("score").alias("high"))
    span = stats.agg(F.max(F.when(F.col("present"), F.col("low"))).alias("a"), F.max(F.when(~F.col("present"), F.col("high"))).alias("b"))  # one row
    inside = by.join(F.broadcast(span), (F.col("score") >= F.col("a")) & (F.col("score") <= F.col("b"))).groupBy("present").agg(F.sum("m").alias("inside"))
    return stats.join(inside, "present", "left").select("present", "n", F.round("low", 6).alias("low"), F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"), F.coalesce("inside", F.lit(0)).alias("inside"))


def weight_sweep(branches: dict[str, DataFrame], k: int, constant: int = 60, sparse: tuple[float, ...] = SPARSE_GRID, summary: tuple[float, ...] = SUMMARY_GRID) -> DataFrame:
    """(w_sparse, w_summary, query_id, id, rank): the first k of lists fused from ranked branches(query_id, id, rank) under every pair of weights; the dense weight stays 1."""
    from cairn.operators.retrieval import stacked

    rows = stacked([b.select("query_id", "id", "rank", F.lit(name).alias("branch")) for name, b in branches.items()])
    grid = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in sparse for b in summary))
    each = rows.withColumn("g", F.explode(grid)).select("query_id", "id", "rank", "branch", F.col("g.a").alias("w_sparse"), F.col("g.b").alias("w_summary"))
    part = F.when(F.col("branch") == "sparse", F.col("w_sparse")).when(F.col("branch") == "summary", F.col("w_summary")).otherwise(1.0) / (F.lit(constant) + F.col("rank"))
    scored = each.groupBy("w_sparse", "w_summary", "query_id", "id").agg(F.round(F.sum(part), 12).alias("score"))
    order = Window.partitionBy("w_sparse", "w_summary", "query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def placed(report: DataFrame, order: list[Column]) -> DataFrame:
    """A report's rows with `place` in its order: for reports of a fixed size, a row a configuration."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def best_ranks(lists: dict[str, DataFrame], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(arm, item, best_rank, hit<k>): of each configuration's ranked list(item, rank, is_target) the best rank of a target, null where none is in it."""
    each = (d.groupBy("item").agg(F.min(F.when(F.col("is_target"), F.col("rank"))).alias("best_rank")).select(F.lit(name).alias("arm"), "item", "best_rank") for name, d in lists.items())
    best = reduce(DataFrame.unionByName, each)
    return best.select("*", *(F.coalesce(F.col("best_rank") <= k, F.lit(False)).alias(f"hit{k}") for k in ks))


def recall_by_anchor(hits: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(category, k, items, any_rate, full_rate), by category, over all ('TOTAL') and over items marked ambiguous ('AMBIGUOUS').

    hits(item, rank, is_target, content), items(item, category, anchors array<string>, ambiguous boolean). A cut-off is hit in part
    if a target row within it holds any anchor, in full if every anchor is held by some target row; items without anchors do not count.
    """
    asked = items.where(F.size("anchors") > 0)
    held = asked.join(hits.where("is_target"), "item").select("item", "rank", F.explode("anchors").alias("anchor"), "content").where(F.contains("content", "anchor"))
    first = held.groupBy("item", "anchor").agg(F.min("rank").alias("rank")).groupBy("item").agg(F.min("rank").alias("any"), F.max("rank").alias("last"), F.count("*").alias("found"))
    each = asked.join(first, "item", "left").select("category", "ambiguous", F.size(F.array_distinct("anchors")).alias("n"), "any", "last", "found", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))).alias("k"))
    any_, full = F.coalesce(F.col("any") <= F.col("k"), F.lit(False)), F.coalesce((F.col("found") == F.col("n")) & (F.col("last") <= F.col("k")), F.lit(False))
    marked = each.select(F.explode(F.filter(F.array(F.col("category"), F.lit("TOTAL"), F.when(F.col("ambiguous"), "AMBIGUOUS")), lambda c: c.isNotNull())).alias("category"), "k", any_.cast("int").alias("a"), full.cast("int").alias("f"))
    return marked.groupBy("category", "k").agg(F.count("*").alias("items"), F.round(F.avg("a"), 6).alias("any_rate"), F.round(F.avg("f"), 6).alias("full_rate"))


def relative_cut(ranked: DataFrame, alpha: float) -> DataFrame:
    """Ranked rows whose score reaches alpha times the query's best."""
    return ranked.withColumn("best__", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= alpha * F.col("best__")).drop("best__")


def gap_cut(ranked: DataFrame, delta: float) -> DataFrame:
    """Ranked rows before the first that falls more than delta below the best so far."""
    upto = Window.partitionBy("query_id").orderBy("rank")
    marked = ranked.withColumn("top__", F.max("score").over(upto)).withColumn("drop__", (F.col("top__") - F.col("score") > delta).cast("int"))
    return marked.withColumn("dropped__", F.max("drop__").over(upto)).where("dropped__ = 0").drop("top__", "drop__", "dropped__")


def compare_arms(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(kind, n): gained, lost, kept, missed, only_a, only_b of two arms' boolean outcomes."""
    both = a.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")).join(b.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")), key, "full")
    kind = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(~F.col("a") & F.col("b"), "gained").when(F.col("a") & ~F.col("b"), "lost").when(F.col("a"), "kept").otherwise("missed")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def regression_verdict(compared: DataFrame, same_provenance: bool = True, allowed: int = 1) -> DataFrame:
    """(net_lost, verdict): more than one net loss is a regression; another provenance, or missing items, cannot be compared."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    totals = compared.agg((n("lost") - n("gained")).alias("net_lost"), (n("only_a") + n("only_b")).alias("uncovered"))
    verdict = F.when(F.lit(not same_provenance) | (F.col("uncovered") > 0), "incomparable").when(F.col("net_lost") > allowed, "regression").otherwise("pass")
    return totals.select("net_lost", "uncovered", verdict.alias("verdict"))


def provenance_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(key, baseline, current) of keys whose values differ or are missing on a side."""
    both = baseline.select("key", F.col("value").alias("baseline")).join(current.select("key", F.col("value").alias("current")), "key", "full")
    return both.where(~F.col("baseline").eqNullSafe(F.col("current")))


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th value; null of nothing."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def interpolated(value: str, p: float) -> Column:
    return F.percentile(value, p)


def banker_p95(values: Column) -> Column:
    """Of an array: the value at place round(0.95 (n - 1)), halves to even."""
    return F.element_at(F.array_sort(values), F.bround(0.95 * (F.size(values) - 1)).cast("int") + 1)


def banker_rank(rows: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """(by, p95_banker): as banker_p95 by rank and count, without gathering a group's values in an array."""
    whole = Window.partitionBy(by)
    placed = rows.where(F.col(value).isNotNull()).withColumn("r__", F.row_number().over(whole.orderBy(value, tie)) - 1).withColumn("n__", F.count("*").over(whole))
    return placed.where(F.col("r__") == F.bround(0.95 * (F.col("n__") - 1)).cast("long")).select(by, F.col(value).alias("p95_banker"))


def capacity(machines: DataFrame) -> DataFrame:
    """(machine, estimate, relative): measured rate, or copy speed times the median ratio where it is missing, times size; relative to the best."""
    ratio = machines.where("rate is not null and copy is not null and copy > 0").agg(F.percentile(F.col("rate") / F.col("copy"), 0.5).alias("ratio"))  # one row
    est = machines.join(F.broadcast(ratio)).withColumn("estimate", F.col("size") * F.coalesce(F.col("rate"), F.col("copy") * F.col("ratio")))
    best = est.agg(F.max("estimate").alias("best"))  # one row
    return est.join(F.broadcast(best)).select("machine", F.round("estimate", 4).alias("estimate"), F.round(F.col("estimate") / F.col("best"), 6).alias("relative"))


def worst_status(rows: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    """(by, worst): the status latest in the order of severity."""
    severity = reduce(lambda acc, x: acc.when(F.col(status) == x[1], x[0]), enumerate(order), F.when(F.lit(False), -1))
    return rows.groupBy(by).agg(F.max_by(F.col(status), severity).alias("worst"))


def matches_target(path: Column, content: Column, suffix: Column, anchors: Column) -> Column:
    """A path with the suffix, whatever the case, and a text with one of the anchors; no anchors match all."""
    has = F.exists(anchors, lambda a: F.lower(content).contains(F.lower(a)))
    return F.lower(path).endswith(F.lower(suffix)) & ((F.size(anchors) == 0) | has)


def anchor_status(anchors: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, status) of anchors(item, file, anchor): no_file, not_in_file, not_indexed, not_in_chunk or ok, of files(file, text) and chunks(file, content)."""
    text = anchors.join(files, "file", "left")
    held = anchors.join(chunks, "file").groupBy("item").agg(F.max(F.col("content").contains(F.col("anchor")).cast("int")).alias("held"))
    out = text.join(held, "item", "left")
    status = F.when(F.col("text").isNull(), "no_file").when(~F.col("text").contains(F.col("anchor")), "not_in_file").when(F.col("held").isNull(), "not_indexed").when(F.col("held") == 0, "not_in_chunk").otherwise("ok")
    return out.select("item", status.alias("status"))


def precision_without_reuse(claims: DataFrame) -> DataFrame:
    """(given, correct, abstained, reused) of claims(query, opportunity, predicted, target): a null prediction abstains, and a target named again in one query counts as reuse, not as correct."""
    order = Window.partitionBy("query", "predicted").orderBy("opportunity")
    seen = claims.withColumn("again", F.col("predicted").isNotNull() & (F.row_number().over(order) > 1))
    given = F.col("predicted").isNotNull()
    return seen.agg(F.count_if(given).alias("given"), F.count_if(given & ~F.col("again") & (F.col("predicted") == F.col("target"))).alias("correct"), F.count_if(~given).alias("abstained"), F.count_if("again").alias("reused"))


def winner_substituted(ranked: DataFrame, stable: DataFrame) -> DataFrame:
    """Ranked rows, the first of each query with its stable score; the order stays as it is."""
    return ranked.join(stable.select("query_id", F.col("score").alias("stable__")), "query_id", "left").withColumn("score", F.when(F.col("rank") == 1, F.coalesce("stable__", "score")).otherwise(F.col("score"))).drop("stable__")


def meta_intent(queries: DataFrame, exemplars: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(query_id, best, is_meta): the largest dot product with any exemplar, of unit vectors. Exemplars are a fixed short list, which is what is broadcast."""
    from cairn.operators.retrieval import best_match

    return best_match(queries, exemplars).select("query_id", F.col("score").alias("best"), (F.col("score") >= threshold).alias("is_meta"))


def valid_calibration(low: Column, high: Column, identity: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(low) & finite(high) & (low >= 0) & (low < high) & (high <= 1) & identity.rlike("^[0-9a-f]{64}$"), F.lit(False))
