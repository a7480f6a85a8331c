"""The registered queries of the ten operators, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1)
    return score(docs, model, least=0.7).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted", "n_passages")


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=fold(5) != 0)
    return score(docs, model, least=0.3).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), distance=3, words=3, seed=42)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), risk=0.02, error=0.05)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, separator=0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_curve_neighbours, op2_toxicity, op3_quality_knn, op4_secret_scans, op5_simhash, op6_quality_rules, op7_best_fit_packing, op8_token_counts, op9_suffix_dedup, op10_byte_bpe)}


#: The base rules and the added one as DuckDB finds them, spelled out by letter case since its (?i) folds more letters than A to Z.
def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = f"(?:{_any_case('password|passwd|secret|token|api_?key')})[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"


def _found(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: (doc_id, row, start, ord, kind, stop)."""
    return f"""SELECT r, s - z AS a, {place} AS ord, '{kind}' AS kind, s AS b FROM (
 SELECT r, z, p, sum(g + z) OVER (PARTITION BY r ORDER BY k) AS s FROM (
  SELECT r, unnest(range(len(ms))) AS k, unnest(list_transform(gs[:len(ms)], lambda x: length(x))) AS g, unnest(list_transform(ms, lambda x: length(x))) AS z, unnest(list_transform(ps, lambda x: length(x))) AS p
  FROM (SELECT r, string_split_regex(t, '{pattern}') AS gs, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS ps FROM d)))
 WHERE p >= {least}"""


def _secrets_sql() -> str:
    from .secrets import PEM

    kinds = [("assign", _ASSIGN, 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("pem", PEM, 0, 1)]
    union = " UNION ALL ".join(_found(k, i, p, g, n) for i, (k, p, g, n) in enumerate(kinds))
    line = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({union}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {line} FILTER (kind <> 'pem') AS base, {line} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def _quality_sql(risk: float = 0.02, error: float = 0.05) -> str:
    from .quality_rules import RULES, cutoffs

    ratio = {"symbols": "n_symbols / greatest(word_chars, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)", "shouting": "n_upper / greatest(word_chars, 1)"}
    assert ratio.keys() == RULES.keys()
    share = risk / len(ratio)
    long = " UNION ALL ".join(f"SELECT stratum, '{k}' AS rule, {v} AS ratio FROM good" for k, v in ratio.items())
    pick = ", ".join(f"max(cutoff) FILTER (rule = '{k}') AS cut_{k}" for k in ratio)
    bad = " OR ".join(f"coalesce({v} > cut_{k}, false)" for k, v in ratio.items())
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {v} > cut_{k} THEN '{k}' END" for k, v in ratio.items()) + ")"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
e AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM w WHERE len(ws) >= 3),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM e) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
c AS (SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
x AS ({long}), cuts AS (SELECT unnest({cutoffs()})::DOUBLE AS cutoff, unnest(range({len(cutoffs())})) AS place),
t AS (SELECT stratum, rule, place, cutoff, count(*) FILTER (ratio > cutoff) AS lost, count(*) AS n FROM x, cuts GROUP BY ALL),
p AS (SELECT t.*, CASE WHEN lost > n * {share!r}::DOUBLE THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({share!r}::DOUBLE) + (n - k) * ln(1 - {share!r}::DOUBLE))) FROM (SELECT unnest(range(lost + 1)) AS k)) END <= {error!r} / ({len(ratio)} * (SELECT count(DISTINCT stratum) FROM good)) AS ok FROM t),
q AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, min(ok::INT) OVER (PARTITION BY stratum, rule ORDER BY place) AS upto FROM p) WHERE upto = 1 GROUP BY ALL),
z AS (SELECT stratum, {pick} FROM q GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept, {reasons} AS reasons FROM b LEFT JOIN z USING (stratum)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scans": _secrets_sql(), "op6_quality_rules": _quality_sql()}
