"""From results to a prompt: gate, context budgets, summaries, prompt family, history, redaction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import strip_entity_prefix

# Budgets of the two assemblies, and the coverage from which texts without summary are left out.
SEARCH_TOKENS, ASK_CHARS, SEPARATOR_CHARS, COVERAGE = 8000, 12000, 7, 0.5
#: Scales whose scores mean the same for every query.
COMPARABLE = ["Cosine", "CrossEncoder"]


def comparable(scale: Column) -> Column:
    return scale.isin(COMPARABLE)


def assess(score: Column, count: Column, scale: Column, low: float, high: float) -> Column:
    """none, mid or high; scores of a scale that cannot be compared are never held against thresholds."""
    return F.when(count == 0, "none").when(~comparable(scale), "high").when(score < low, "none").when(score < high, "mid").otherwise("high")


def budget_stop(rows: DataFrame, by: str, order: list[str], tokens: str, budget: int = SEARCH_TOKENS, used: int = 0) -> DataFrame:
    """Rows in order up to the first that overflows the budget."""
    upto = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("total__", F.sum(tokens).over(upto) + used).where(F.col("total__") <= budget).drop("total__")


def budget_skip(sizes: Column, budget: int = ASK_CHARS, separator: int = SEPARATOR_CHARS) -> Column:
    """Whether each size, in order, is taken: one that does not fit is skipped and the next tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n + separator <= budget
        used = F.when(fits, acc["used"] + n + F.when(acc["used"] > 0, separator).otherwise(0)).otherwise(acc["used"])
        return F.struct(used.cast("long").alias("used"), F.concat(acc["out"], F.array(fits)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def taken_within(rows: DataFrame, by: str, order: str, size: str, budget: int = ASK_CHARS, separator: int = SEPARATOR_CHARS) -> DataFrame:
    """(by, order) of the rows that budget_skip takes in each group: one pass over sorted rows, in which nothing but the room used is held. Sizes alone that are over the budget are left out before."""
    slim = rows.select(by, order, F.col(size).cast("long").alias("size__")).where(F.col("size__") + separator <= budget)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, first = None, 0, True
        for b in batches:
            ok = []
            for i, (key, n) in enumerate(zip(b.column(by).to_pylist(), b.column("size__").to_pylist())):
                if first or key != now:
                    now, used, first = key, 0, False
                if used + n + separator <= budget:
                    used += n + (separator if used > 0 else 0)
                    ok.append(i)
            yield b.select([by, order]).take(pa.array(ok, pa.int64()))

    return slim.repartition(by).sortWithinPartitions(by, order, "size__").mapInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}")


def swap_summaries(chunks: DataFrame, by: str, threshold: float = COVERAGE) -> DataFrame:
    """Chunks(by, content, found, summary) with summaries for content; those without go once enough others have one."""
    covered = F.col("found") & F.col("summary").isNotNull()
    whole = Window.partitionBy(by)
    share = chunks.withColumn("covered__", covered).withColumn("n__", F.count_if(covered).over(whole)).withColumn("share__", F.col("n__") / F.count("*").over(whole))
    kept = share.where(F.col("covered__") | ~((F.col("n__") > 0) & (F.col("share__") >= threshold)))
    return kept.withColumn("content", F.when(F.col("covered__"), strip_entity_prefix(F.col("summary"))).otherwise(F.col("content"))).drop("covered__", "n__", "share__")


def cache_state(hash_: Column, negative: Column) -> Column:
    """miss, negative or hit of a left-joined summary cache."""
    return F.when(hash_.isNull(), "miss").when(negative, "negative").otherwise("hit")


def prompt_family(documents: Column, count: Column, simple: Column, forced: Column) -> Column:
    """Simple mode first, then the family that a profile forces, then docs if half the chunks or more are documentation."""
    return F.when(simple, "simple").when(forced.isin("code", "docs"), forced).when(documents * 2 >= count, "docs").otherwise("code")


def history(turns: DataFrame, by: str, order: str) -> DataFrame:
    """(by, messages): role and text of a conversation's turns, in order."""
    packed = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    return turns.groupBy(by).agg(F.transform(packed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("messages"))


def redact_source(mode: Column, prose: Column, value: Column, kind: str) -> Column:
    """A source's field by response mode: technical shows all; simple hides lines of prose, and all but score and summary of code."""
    if kind == "line":
        return F.when(mode == "Technical", value)
    return F.when((mode == "Technical") | prose, value)


def visible_question(text: Column, flag: Column, expires: Column, now: Column) -> Column:
    """The text while logging of contents is on and not expired, else its length."""
    return F.when(flag & expires.isNotNull() & (now < expires), text).otherwise(F.concat(F.lit("len="), F.length(text)))


def omission_note(taken: Column, offered: Column) -> Column:
    """What an assembled context says of results that did not fit; null where all did."""
    return F.when(taken < offered, F.concat(F.lit("["), (offered - taken).cast("string"), F.lit(" of "), offered.cast("string"), F.lit(" results left out]")))


def ask(questions: DataFrame, meta: DataFrame, ranked: DataFrame, texts: DataFrame, low: float, high: float, budget: int = ASK_CHARS) -> DataFrame:
    """(query_id, band, route, sources, context, note): one plan from questions to what a generator is given.

    questions(query_id), meta(query_id, is_meta), ranked(query_id, id, rank, score, scale), texts(id, text). A question about the
    assistant itself is answered without search; without grounding (band none) nothing is handed on; else results are taken in
    rank order while they fit the budget, one that does not fit is skipped.
    """
    best = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("score", -F.col("rank")).alias("score"), F.max_by("scale", -F.col("rank")).alias("scale"))
    gated = questions.select("query_id").join(meta, "query_id", "left").join(best, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gated = gated.withColumn("band", assess(F.col("score"), F.col("n"), F.col("scale"), low, high)).withColumn("route", F.when(F.coalesce("is_meta", F.lit(False)), "meta").when(F.col("band") == "none", "declined").otherwise("grounded"))
    # Texts join the results of grounded questions alone.
    rows = gated.where("route = 'grounded'").select("query_id").join(ranked, "query_id").join(texts, "id")
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text"))).alias("xs"))
    fits = F.arrays_zip(F.col("xs").alias("x"), budget_skip(F.transform("xs", lambda x: F.length(x["text"]).cast("long")), budget).alias("ok"))
    taken = packed.select("query_id", F.size("xs").alias("offered"), F.transform(F.filter(fits, lambda p: p["ok"]), lambda p: p["x"]).alias("kept"))
    made = taken.select("query_id", F.transform("kept", lambda x: x["id"]).alias("sources"), F.array_join(F.transform("kept", lambda x: x["text"]), "\n\n---\n\n").alias("context"), omission_note(F.size("kept"), F.col("offered")).alias("note"))
    return gated.select("query_id", "band", "route").join(made, "query_id", "left")


def ask_events(query: str, assessed: str, sources: int, answer: list[str], fallback: str) -> list[tuple[int, str, str]]:
    """(n, kind, payload) of one answer as it is streamed: the context (sources hidden without grounding), fragments, completion."""
    grounded = assessed != "none"
    out = [(0, "ContextReady", str(sources if grounded else 0)), *((i, "Fragment", t) for i, t in enumerate(answer, 1))]
    declined = "".join(answer).strip() == fallback
    return [*out, (len(out), "Completed", "declined" if declined else "answered")]
