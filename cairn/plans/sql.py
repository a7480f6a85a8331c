"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from cairn.functions import text as T


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LEXER = T.LEXER.replace("'", "''")
WORDS = f"""flatten(list_transform(list_filter(regexp_extract_all(@text@, '{LEXER}'), lambda w: regexp_matches(w, '^\\p{{L}}')),
 lambda w: string_split(regexp_replace(regexp_replace(w, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), ' ')))"""
STEM = "regexp_replace(regexp_replace(@word@, '^(.{3,}[^s])s$', '\\1'), '^(.{4,})[aoe]$', '\\1')"


def words(text: str) -> str:
    return WORDS.replace("@text@", text)


def stem(word: str) -> str:
    return STEM.replace("@word@", word)


def terms(name: str, table: str, id_: str, text: str) -> str:
    """CTEs <name>_words(id, w) and <name>(id, term, n, weight)."""
    drop = quoted(sorted({*T.STOP_WORDS, *T.DROPPED_WORDS}))
    term = stem(f"translate(lower(w), '{T.ACCENTS}', '{T.PLAIN}')")
    idf = f"CASE WHEN term IN ({quoted(T.stemmed(T.HEAVY_WORDS))}) THEN {T.HEAVY} WHEN term IN ({quoted(T.stemmed(T.MODERATE_WORDS))}) THEN {T.MODERATE} ELSE 1.0 END"
    return f"""{name}_words AS (SELECT {id_} AS id, unnest({words(text)}) AS w FROM {table}),
{name}_terms AS (SELECT id, {term} AS term FROM {name}_words WHERE length(w) BETWEEN {T.MIN_TERM} AND {T.MAX_TERM} AND lower(w) NOT IN ({drop})),
{name} AS (SELECT id, term, n, (least(n, {T.MAX_COUNT})::DOUBLE / (least(n, {T.MAX_COUNT})::DOUBLE + 1) * ({idf})::DOUBLE) AS weight FROM (SELECT id, term, count(*) AS n FROM {name}_terms GROUP BY ALL))"""


def uuid5(name: str) -> str:
    h = f"sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return f"""(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4 + 1)::BIGINT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"""


#: Exact neighbours of every fiftieth vector: dense(query_id, id, score, rank).
DENSE = """dense_scores AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
 FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings d WHERE d.vec_id <> q.vec_id{where}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense_scores) WHERE rank <= {k})"""


def dense(k: int, where: str = "") -> str:
    return DENSE.format(k=k, where=where)


#: Every fiftieth document asks all documents, by shared terms: sparse(query_id, id, score, rank).
def sparse(k: int) -> str:
    return f"""{terms("post", "documents", "doc_id", "text")},
sparse_scores AS (SELECT q.id AS query_id, d.id AS id, round(sum(q.weight * d.weight), 9) AS score FROM post q JOIN post d USING (term) WHERE q.id % 50 = 0 AND q.id <> d.id GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sparse_scores) WHERE rank <= {k})"""


CHUNK_LINES = "string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
