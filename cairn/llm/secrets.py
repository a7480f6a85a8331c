"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger says which (blob, rule version) pairs have
been scanned and what was found; a scan takes the blobs that it has not seen under a rule's present version, once each
however many paths hold them, and findings are joined back to all paths. Each rule has cheap necessary words (a gate): a
blob that fails a rule's gate has no match and needs no scan by it, so its text is never shuffled.

Matches are leftmost and non-overlapping for each rule, in code points with the end exclusive: the lengths of the parts between
matches and of the matches, summed along the text, give the places. Null texts count as empty and have no finding;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, texts


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule; group: the part whose length must reach `least`; gates: texts, lower-cased, of which a match holds one; gate: a pattern that a match fulfils."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    gates: tuple[str, ...] = ()
    gate: str = ""
    base: bool = True


#: A private key from its first line to its last; where that is missing, to the end of the encoded block.
PEM = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\x20\x09-\x0D-]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,})*)"

#: The base rules in the order in which kinds are listed, then one that the engine adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, gates=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, gates=("akia",)),
    Rule("hex", r"[0-9a-f]+", 32, gate=r"[0-9a-f]{32}"),
    Rule("pem", PEM, 1, gates=("private key-----",), base=False, version=2),
)


def gates(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The kinds of the rules that a text may match; none for a null text."""
    low = F.lower(text)
    tests = lambda r: [low.contains(word) for word in r.gates] + ([text.rlike(r.gate)] if r.gate else [])
    return F.filter(F.array(*(F.when(reduce(or_, tests(r)), F.lit(r.kind)) for r in rules)), lambda k: k.isNotNull())


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end) of blobs(blob, text, kinds): each blob is scanned by the kinds that it lists, all of them in one pass."""
    body = F.col("text")

    def cut(rule: Rule) -> Column:
        gaps = F.transform(F.split(body, rule.pattern, -1), F.length)
        sizes, parts = (F.transform(F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(g)), F.length) for g in (0, rule.group))
        said = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), parts.alias("part")).alias("parts"))
        return F.when(F.array_contains("kinds", rule.kind), said)

    each = blobs.select("blob", F.explode(F.filter(F.array(*map(cut, rules)), lambda r: r.isNotNull())).alias("r"))
    each = each.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.parts").alias("at", "x"))
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("end", F.sum(F.col("x.gap") + F.coalesce("x.size", F.lit(0))).over(upto))
    return ended.where(F.col("x.part") >= F.col("least")).select("blob", "kind", "version", (F.col("end") - F.col("x.size")).alias("start"), "end")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, additions): paths(doc_id, blob, spans) with spans array<struct<start, ord, kind, end>> by start, then kind as listed; additions: the ledger's new rows (blob, kind, version, spans).

    ledger(blob, kind, version, spans): earlier additions; its pairs are not scanned again. A new rule version makes its pairs unseen.
    Store additions beside the ledger to make the next scan incremental.
    """
    # One pass addresses and gates all texts; texts that pass no gate are not kept.
    addressed = texts(docs, id_col, text_col).withColumn("blob", F.sha2("text", 256)).withColumn("gated", gates(F.col("text"), rules))
    paths = stored(addressed.withColumn("text", F.when(F.size("gated") > 0, F.col("text"))))
    some = paths.where(F.size("gated") > 0)
    wanted = some.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.first("gated").alias("gated")).select("blob", "doc_id", F.explode("gated").alias("kind"))
    versions = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.version))))
    if ledger is not None:
        wanted = wanted.withColumn("version", versions[F.col("kind")]).join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    unseen = wanted.groupBy("blob").agg(F.first("doc_id").alias("doc_id"), F.collect_set("kind").alias("kinds"))
    # One path stands for its blob; of rows that repeat one doc_id and text, one is read. Blobs are dealt to all tasks, whatever their size.
    held, first = some.select("doc_id", "blob", "text").alias("held"), unseen.alias("first")
    mine = (F.col("held.blob") == F.col("first.blob")) & F.col("held.doc_id").eqNullSafe(F.col("first.doc_id"))
    read = held.join(first, mine).select("held.blob", "held.text", "first.kinds").dropDuplicates(["blob"]).repartition(partitions(docs.sparkSession), "blob")
    spot = F.struct(F.col("start").cast("long").alias("start"), F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("kind")).alias("ord"), "kind", F.col("end").cast("long").alias("end"))
    found = findings(read, rules).groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(spot)).alias("spans"))
    pairs = wanted.select("blob", "kind").distinct().withColumn("version", versions[F.col("kind")])
    additions = stored(pairs.join(found, ["blob", "kind", "version"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))))
    known = additions if ledger is None else additions.unionByName(ledger.where(reduce(or_, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules))).select(*additions.columns))
    by_blob = known.where(F.size("spans") > 0).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.select("doc_id", "blob").join(by_blob, "blob", "left"), additions


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    paths, _ = scan(docs, ledger, rules, id_col, text_col)
    base = [r.kind for r in rules if r.base]
    all_ = F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))
    return paths.withColumn("spans", all_).select(
        "doc_id",
        *(F.size(_of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in rules if r.base),
        F.sha2(_joined(_of(base)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with every span of a secret (overlapping ones as one) replaced by `mask` in the text.

    Findings meet their texts again by blob; texts that pass no gate, nulls among them, are left where they are.
    """
    body = F.col(text_col).cast("string")
    marked = stored(docs.withColumn("_cairn_gated", F.size(gates(body, rules)) > 0))
    some = marked.where("_cairn_gated")
    _, additions = scan(some.select(id_col, text_col), None, rules, id_col, text_col)
    spans = additions.where(F.size("spans") > 0).groupBy(F.col("blob").alias("_cairn_blob")).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("_cairn_spans"))
    held = some.withColumn("_cairn_blob", F.sha2(body, 256)).join(spans, "_cairn_blob", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        # A span that begins inside the one before lengthens it.
        gap = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.lit(mask)))).alias("parts"))

    clean = F.aggregate("_cairn_spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.lit(1 << 30))))
    changed = held.withColumn(text_col, F.when(F.col("_cairn_spans").isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns)
    return marked.where("not _cairn_gated").select(*docs.columns).unionByName(changed)
