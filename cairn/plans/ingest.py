"""Registered queries: chunking, stores, states, census, context, access and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as T
from cairn.operators import access as A
from cairn.operators import census as N
from cairn.operators import chunking as C
from cairn.operators import context as X
from cairn.operators import evaluation as E
from cairn.operators import retrieval as R
from cairn.operators import store as S
from cairn.sources import files as L

from . import sql as Q
from .search import documents, table

_TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_LINES = Q.CHUNK_LINES


def _files(spark, sf) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


def window_chunks(spark, sf):
    c = C.window_chunks(_files(spark, sf), size=25, step=22)
    return c.select(F.col("id").alias("doc_id"), "fragment", "start_line", "end_line", I.content_hash(F.col("content")).alias("content_hash"))


def _windows(size: int, step: int, least: int = 0) -> str:
    return f"""l AS (SELECT doc_id, {_LINES} AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, len(ls), {step})) AS i FROM l),
c AS (SELECT doc_id, i + 1 AS start_line, least(i + {size}, len(ls)) AS end_line, array_to_string(ls[i + 1 : i + {size}], chr(10)) AS content FROM w WHERE i = 0 OR i - {step} + {size} < len(ls)),
t AS (SELECT doc_id, start_line, end_line, {_TRIM} AS content FROM c),
chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS fragment FROM t WHERE length(content) > {least})"""


WINDOW_CHUNKS = f"WITH {_windows(25, 22)} SELECT doc_id, fragment, start_line, end_line, sha256(content) AS content_hash FROM chunks"


def calibration_windows(spark, sf):
    c = C.window_chunks(_files(spark, sf), size=40, step=40, min_chars=199)
    c = c.withColumn("tokens", T.token_estimate(F.col("content"))).withColumn("part", I.split_70_30(F.col("content")))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum(F.length("content")) / F.sum("tokens"), 6).alias("chars_per_token"), F.round(F.avg(F.col("tokens") - F.length("content") / 3.49), 6).alias("bias"))


CALIBRATION_WINDOWS = f"""WITH {_windows(40, 40, 199)}, k AS (SELECT content, ceil(length(content) / 4.0)::BIGINT AS tokens, CASE WHEN ('0x' || substr(sha256(content), 1, 2))::INT % 10 >= 7 THEN 'check' ELSE 'calibration' END AS part FROM chunks)
SELECT part, count(*) AS n, round(sum(length(content)) / sum(tokens), 6)::DOUBLE AS chars_per_token, round(avg(tokens - length(content) / 3.49::DOUBLE), 6) AS bias FROM k GROUP BY part"""


def _markdown(spark, sf) -> DataFrame:
    """Documents as Markdown: a line that ends a short sentence of its own becomes a header, and blank lines part paragraphs."""
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.when(F.length(s) < 40, F.concat(F.lit("## "), s)).otherwise(F.concat(s, F.lit("\n"))))
    return documents(spark, sf).select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text"))


def markdown_sections(spark, sf):
    return C.markdown_chunks(_markdown(spark, sf)).select(F.col("id").alias("doc_id"), "section", "chunk", "start_line", "end_line", I.content_hash(F.col("content")).alias("content_hash"))


MARKDOWN_SECTIONS = r"""WITH RECURSIVE md AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN length(s) < 40 THEN '## ' || s ELSE s || chr(10) END), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM md),
h AS (SELECT *, regexp_matches(line, '^(#{1,6})\s+(.*)') AS hd, sum(regexp_matches(line, '^(#{1,6})\s+(.*)')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM e),
s AS (SELECT doc_id, section, min(i) + 1 AS section_start, coalesce(trim(regexp_replace(max(line) FILTER (hd), '^#+', '')), 'Documento Principal') AS header FROM h GROUP BY ALL),
b AS (SELECT h.*, trim(regexp_replace(line, '\s+', ' ', 'g')) = '' AS blank, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS n FROM h WHERE NOT hd),
p AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id, section ORDER BY i) AS para FROM b),
q AS (SELECT doc_id, section, para, min(n) AS low, max(n) AS high, string_agg(line, chr(10) ORDER BY i) AS text FROM p WHERE NOT blank GROUP BY ALL),
r AS (SELECT q.*, s.section_start, s.header, '[Sección: ' || s.header || ']' AS label, row_number() OVER (PARTITION BY doc_id, section ORDER BY para) AS k FROM q JOIN s USING (doc_id, section)),
g AS (SELECT doc_id, section, k, length(label) + 2 + length(text) AS size, 0 AS chunk FROM r WHERE k = 1
 UNION ALL SELECT r.doc_id, r.section, r.k, CASE WHEN ceil((g.size + 2 + length(r.text)) / 4.0) > 512 THEN length(r.label) + 2 + length(r.text) ELSE g.size + 2 + length(r.text) END, CASE WHEN ceil((g.size + 2 + length(r.text)) / 4.0) > 512 THEN g.chunk + 1 ELSE g.chunk END
 FROM g JOIN r ON r.doc_id = g.doc_id AND r.section = g.section AND r.k = g.k + 1)
SELECT doc_id, section::BIGINT AS section, chunk::BIGINT AS chunk, (CASE WHEN chunk = 0 THEN any_value(section_start) ELSE min(section_start + low) END)::BIGINT AS start_line, max(section_start + high)::BIGINT AS end_line,
 sha256(any_value(label) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY k)) AS content_hash FROM g JOIN r USING (doc_id, section, k) GROUP BY doc_id, section, chunk"""


def brace_blocks(spark, sf):
    """Documents dressed as code: every other line opens a function that the next one closes."""
    code = F.array_join(F.transform(F.split("text", "\n", -1), lambda s, i: F.when(i % 2 == 0, F.concat(F.lit("function f"), i.cast("string"), F.lit("(a) { // "), s)).otherwise(F.concat(F.lit("'"), F.regexp_replace(s, "['\\\\]", ""), F.lit("'; }")))), "\n")
    return C.brace_chunks(documents(spark, sf).select(F.col("doc_id").alias("id"), code.alias("text"))).select(F.col("id").alias("doc_id"), "kind", "name", "start_line", "end_line")


BRACE_BLOCKS = """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), f AS (SELECT doc_id, n, unnest(range(0, n, 2)) AS i FROM l)
SELECT doc_id, 'Function' AS kind, 'f' || i AS name, i + 1 AS start_line, least(i + 2, n) AS end_line FROM f"""


def document_symbols(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(C.symbols(F.col("text"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("docs"))


_TS = C.TS_LEXER.replace("'", "''")
DOCUMENT_SYMBOLS = f"""SELECT symbol, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(text, '{_TS}'), lambda w: regexp_matches(w, '^[\\p{{L}}_$]'))) AS symbol FROM documents) WHERE symbol NOT IN ({Q.quoted(C.TS_NOISE)}) GROUP BY symbol"""


def indexable_chunks(spark, sf):
    kind = F.when(F.col("n_chars") % 3 == 0, "Class").otherwise("Method")
    name = F.regexp_extract("text", r"^(\w+)", 1)
    ok = C.indexable(F.col("text"), kind, name, F.split("text", " "), keep_short_types=True)
    return documents(spark, sf).where(ok).select("doc_id", kind.alias("kind"))


INDEXABLE_CHUNKS = """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'Class' ELSE 'Method' END AS kind FROM documents
WHERE length(trim(text)) >= 60 OR (n_chars % 3 = 0 AND list_contains(string_split(text, ' '), regexp_extract(text, '^(\\w+)', 1)))"""


def superseded_delete(spark, sf):
    d = documents(spark, sf).select("source", I.content_hash(F.concat("text", F.col("doc_id").cast("string"))).alias("chunk"), "doc_id")
    return S.superseded(d, d.where("doc_id % 3 <> 0 and doc_id % 2 = 0"), "source", "chunk").select("doc_id", "source")


SUPERSEDED_DELETE = """WITH c AS (SELECT * FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0)
SELECT doc_id, source FROM documents d WHERE source IN (SELECT source FROM c) AND doc_id NOT IN (SELECT doc_id FROM c)"""


def upsert_latest(spark, sf):
    return S.upsert_latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.round("value", 6).alias("value")), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


UPSERT_LATEST = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def merge_points(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang", "source")
    new = d.where("doc_id % 4 = 0").withColumn("lang", F.lit("xx")).unionByName(d.where("doc_id % 7 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "lang", "source"))
    return S.merge_points(d, new, "doc_id")


MERGE_POINTS = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents UNION ALL SELECT -doc_id - 1, lang, source FROM documents WHERE doc_id % 7 = 0"""


def partial_update(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang", "source")
    gone = d.where("doc_id % 11 = 0").select("doc_id")
    return S.delete_by_id(S.partial_update(d, d.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "zz").alias("lang")), "doc_id", ["lang"]), gone, "doc_id")


PARTIAL_UPDATE = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'zz' ELSE lang END AS lang, source FROM documents WHERE doc_id % 11 <> 0"


def preserve_summaries(spark, sf):
    d = documents(spark, sf)
    old = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary"))
    return S.preserve(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "new").alias("summary")), old, "doc_id", ["summary"])


PRESERVE_SUMMARIES = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 's' || doc_id END AS summary FROM documents"


def insert_or_ignore(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return S.insert_or_ignore(e.where("event_type = 'error' and user_id % 2 = 0"), e.where("event_type <> 'error'"), "user_id", "event_id").select("user_id", "event_id", "event_type")


INSERT_OR_IGNORE = """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type <> 'error')
WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0)"""


def audit_purge_dryrun(spark, sf):
    e = table(spark, sf, "events")
    cut = e.agg(F.expr("max(ts) - interval 7 days").alias("cutoff"))  # one row
    marked = e.join(F.broadcast(cut))
    return marked.groupBy("event_type").agg(F.count_if((F.col("ts") < F.col("cutoff")) & (F.col("user_id") % 10 != 0)).alias("candidates"), F.count_if((F.col("ts") < F.col("cutoff")) & (F.col("user_id") % 10 == 0)).alias("held"))


AUDIT_PURGE_DRYRUN = """SELECT event_type, count(*) FILTER (ts < c AND user_id % 10 <> 0) AS candidates, count(*) FILTER (ts < c AND user_id % 10 = 0) AS held FROM events, (SELECT max(ts) - INTERVAL 7 DAY AS c FROM events) GROUP BY event_type"""


def document_state(spark, sf):
    e = table(spark, sf, "events")
    counts = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("confirmed"), F.max(F.when(F.col("event_type") == "signup", F.lit(1))).alias("expected"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    last = S.latest_state(e, "user_id", "ts", "event_type", "event_id")
    return counts.join(last, "user_id").select("user_id", S.completion(F.col("confirmed"), F.col("expected"), F.col("failed")).alias("status"), F.col("state").alias("last"), (F.col("started_at") == F.col("a")).alias("start_kept"))


DOCUMENT_STATE = """SELECT user_id, CASE WHEN f > 0 THEN 'Failed' WHEN x IS NULL THEN 'Processing' WHEN c >= x THEN 'Succeeded' ELSE 'Processing' END AS status, last, true AS start_kept
FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS c, max(CASE WHEN event_type = 'signup' THEN 1 END) AS x, count(*) FILTER (event_type = 'error') AS f, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)"""


def failure_streak(spark, sf):
    s = S.streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.count_if(F.col("streak") >= 2).alias("tripped"))


FAILURE_STREAK = """WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r)
SELECT user_id, max(streak)::BIGINT AS longest, count(*) FILTER (streak >= 2) AS tripped FROM s GROUP BY user_id"""


def rate_limit_fixed_window(spark, sf):
    from cairn.streaming.limits import fixed_window

    e = table(spark, sf, "events").withColumn("actor", (F.col("user_id") % 7).cast("string"))
    return fixed_window(e, "actor", "ts", "event_id", seconds=3600, permits=3).groupBy("actor").agg(F.count("*").alias("asked"), F.count_if("rejected").alias("rejected"))


RATE_LIMIT_FIXED_WINDOW = """SELECT actor, count(*) AS asked, count(*) FILTER (n > 3) AS rejected FROM (SELECT (user_id % 7)::VARCHAR AS actor, row_number() OVER (PARTITION BY user_id % 7, epoch(ts)::BIGINT // 3600 ORDER BY ts, event_id) AS n FROM events) GROUP BY actor"""


def concurrency_peak(spark, sf):
    from cairn.streaming.limits import concurrency

    e = table(spark, sf, "events").where("value is not null").select((F.col("user_id") % 7).cast("string").alias("actor"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), "event_id")
    spans = e.select("actor", "start", (F.col("start") + (F.col("event_id") % 50 + 1) * 60_000_000).alias("end"))
    return concurrency(spans, "actor", 2).groupBy("actor").agg(F.max("running").cast("long").alias("peak"), F.count_if("over").alias("over"))


CONCURRENCY_PEAK = """WITH e AS (SELECT (user_id % 7)::VARCHAR AS actor, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 50 + 1) * 60000000 AS t FROM events WHERE value IS NOT NULL),
p AS (SELECT actor, s AS moment, 1 AS d FROM e UNION ALL SELECT actor, t, -1 FROM e), g AS (SELECT actor, moment, sum(d) AS d, sum((d > 0)::INT) AS begun FROM p GROUP BY ALL),
r AS (SELECT actor, moment, begun, sum(d) OVER (PARTITION BY actor ORDER BY moment) AS running FROM g)
SELECT actor, max(running)::BIGINT AS peak, count(*) FILTER (running > 2 AND begun > 0) AS "over" FROM r GROUP BY actor"""


def ingest_summary(spark, sf):
    c = C.window_chunks(_files(spark, sf), size=25, step=22).withColumn("tokens", T.token_estimate(F.col("content")))
    return c.agg(F.count_distinct("id").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("tokens") > 254).alias("truncated"), F.sum(F.greatest(F.col("tokens") - 254, F.lit(0))).alias("discarded"), F.max("tokens").alias("longest"), E.nearest_rank("tokens", 0.5).cast("long").alias("p50"), E.nearest_rank("tokens", 0.95).cast("long").alias("p95"))


INGEST_SUMMARY = f"""WITH {_windows(25, 22)}, k AS (SELECT doc_id, ceil(length(content) / 4.0)::BIGINT AS t FROM chunks)
SELECT count(DISTINCT doc_id) AS files, count(*) AS chunks, count(*) FILTER (t > 254) AS truncated, sum(greatest(t - 254, 0))::BIGINT AS discarded, max(t) AS longest, quantile_disc(t, 0.5)::BIGINT AS p50, quantile_disc(t, 0.95)::BIGINT AS p95 FROM k"""


def corpus_census(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("root"), F.concat(F.lit("."), F.col("lang")).alias("extension"), I.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("walk"))
    return N.corpus_census(d.withColumn("state", N.admission(F.col("extension"), [".en"], [".de", ".fr"])))


CORPUS_CENSUS = """WITH f AS (SELECT source AS root, '.' || lang AS extension, CASE WHEN lang = 'en' THEN 'admitido_estructural' WHEN lang IN ('de', 'fr') THEN 'admitido_fallback' ELSE 'no_admitido' END AS state, strlen(text) AS size,
 row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 AS u FROM documents)
SELECT coalesce(root, '*') AS root, extension, state, count(*) AS files, count(*) FILTER (u) AS unique_files, count(*) FILTER (NOT u) AS duplicates, sum(CASE WHEN u THEN size ELSE 0 END)::BIGINT AS unique_bytes FROM f GROUP BY GROUPING SETS ((root, extension, state), (extension, state))"""


def reduction_factor(spark, sf):
    return N.reduction(C.window_chunks(_files(spark, sf), size=25, step=22).join(documents(spark, sf).select(F.col("doc_id").alias("id"), "source", "lang"), "id"), ["source", "lang"])


REDUCTION_FACTOR = f"WITH {_windows(25, 22)}, g AS (SELECT source, lang, count(*) AS n FROM chunks JOIN documents USING (doc_id) GROUP BY ALL) SELECT sum(n)::BIGINT AS chunks, count(*) AS groups, round(sum(n) / count(*), 2)::DOUBLE AS factor FROM g"


def summary_groups(spark, sf):
    d = documents(spark, sf).select("source", "lang", I.content_hash(F.col("text")).alias("h"))
    return d.groupBy("source", "lang").agg(I.group_hash(F.collect_list("h")).alias("group_hash"), F.count("*").alias("n"))


SUMMARY_GROUPS = "SELECT source, lang, sha256(string_agg(sha256(text), '|' ORDER BY sha256(text))) AS group_hash, count(*) AS n FROM documents GROUP BY ALL"


def symbol_join_census(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("tenant"), F.array_distinct(T.terms(F.col("text"))).alias("t"))
    return N.symbol_sets_join(d.select("id", "tenant", F.slice("t", 1, 3).alias("defined"), F.slice("t", 4, F.greatest(F.size("t"), F.lit(1))).alias("consumed")))


SYMBOL_JOIN_CENSUS = f"""WITH w AS (SELECT doc_id, source, list_filter({Q.words('text')}, lambda w: length(w) BETWEEN 2 AND 128 AND lower(w) NOT IN ({Q.quoted(sorted({*T.STOP_WORDS, *T.DROPPED_WORDS}))})) AS ws FROM documents),
e AS (SELECT doc_id, source, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM w), t AS (SELECT doc_id, source, {Q.stem(f"translate(lower(w), '{T.ACCENTS}', '{T.PLAIN}')")} AS term, min(p) AS p FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM t)
SELECT tenant, count(*) AS pairs FROM (SELECT DISTINCT a.source AS tenant, a.doc_id AS src, b.doc_id AS dst FROM k a JOIN k b ON a.source = b.source AND a.term = b.term AND a.i > 3 AND b.i <= 3 AND a.doc_id <> b.doc_id) GROUP BY tenant"""


def graph_bfs(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    edges = lambda nodes: R.dense_topk(v.join(nodes.withColumnRenamed("node", "id"), "id", "left_semi").withColumnRenamed("id", "query_id"), v, 3).select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    allowed = v.where("label <> 9").select(F.col("id").alias("node"))
    return N.walk(edges, v.where("id % 50 = 0").select(F.col("id").alias("node")), allowed, 3)


GRAPH_BFS = """WITH RECURSIVE s AS (SELECT q.vec_id AS src, d.vec_id AS dst, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id <> d.vec_id),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM s) WHERE r <= 3), ok AS (SELECT vec_id AS node FROM embeddings WHERE label <> 9),
w AS (SELECT node AS seed, node, 0 AS hop FROM ok WHERE node % 50 = 0 UNION SELECT w.seed, e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node JOIN ok ON ok.node = e.dst WHERE w.hop < 3)
SELECT seed, node, min(hop)::BIGINT AS hop FROM w GROUP BY ALL"""


def context_budget_stop(spark, sf):
    d = documents(spark, sf).select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return X.budget_stop(d, "source", ["doc_id"], "tokens", 8000, used=20).select("source", "doc_id")


CONTEXT_BUDGET_STOP = "SELECT source, doc_id FROM (SELECT source, doc_id, 20 + sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents) WHERE total <= 8000"


def context_budget_skip(spark, sf):
    return X.taken_within(documents(spark, sf).select("source", "doc_id", F.length("text").alias("n")), "source", "doc_id", "n")


CONTEXT_BUDGET_SKIP = """WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, n + 7 <= 12000 AS ok, CASE WHEN n + 7 <= 12000 THEN n ELSE 0 END AS used FROM d WHERE k = 1
 UNION ALL SELECT d.source, d.doc_id, d.k, f.used + d.n + 7 <= 12000, CASE WHEN f.used + d.n + 7 <= 12000 THEN f.used + d.n + CASE WHEN f.used > 0 THEN 7 ELSE 0 END ELSE f.used END FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
SELECT source, doc_id FROM f WHERE ok"""


def summary_swap(spark, sf):
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", F.col("text").alias("content"), F.col("quality").isNotNull().alias("found"), F.when(F.col("quality") == 1, F.concat(F.lit("Entity: "), F.substring("text", 1, 40))).alias("summary"))
    return X.swap_summaries(d, "source", 0.35).select("doc_id", "source", I.content_hash(F.col("content")).alias("content_hash"))


SUMMARY_SWAP = """WITH d AS (SELECT doc_id, source, text, CASE WHEN quality = 1 THEN 'Entity: ' || substr(text, 1, 40) END AS summary FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, count(summary) OVER (PARTITION BY source) AS n, count(summary) OVER (PARTITION BY source) / count(*) OVER (PARTITION BY source) AS share FROM d)
SELECT doc_id, source, sha256(coalesce(regexp_replace(summary, '^\\s*[^\\n:]{1,80}:\\s*', ''), text)) AS content_hash FROM s WHERE summary IS NOT NULL OR NOT (n > 0 AND share >= 0.35)"""


def chat_history(spark, sf):
    h = X.history(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return h.select("conv_id", F.size("messages").cast("long").alias("turns"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n"), 256).alias("digest"))


CHAT_HISTORY = "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM (SELECT conv_id, turn, role, text FROM conversations) GROUP BY conv_id"


def sanitize_counts(spark, sf):
    c = table(spark, sf, "conversations").select("text", "role")
    d = c.unionByName(documents(spark, sf).select("text", F.col("lang").alias("role")))
    counts = [F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(n) for n, p in T.TECHNICAL.items()]
    return d.groupBy("role", T.stance(F.col("text")).alias("stance")).agg(F.count("*").alias("n"), *counts, F.sum(T.lexicon_count(F.col("text"), T.CERTAIN)).alias("certain"), F.sum(T.lexicon_count(F.col("text"), T.VAGUE)).alias("vague"))


def _has(marks: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{m}')" for m in marks)


def _lex(words: list[str]) -> str:
    return " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in words)


_TECH = ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {n}" for n, p in T.TECHNICAL.items())
SANITIZE_COUNTS = f"""SELECT role, CASE WHEN {_has(T.REFUSALS)} THEN 'rechazo_pleno' WHEN {_has(T.HEDGES)} THEN 'banda_baja' ELSE 'directo' END AS stance, count(*) AS n, {_TECH}, sum({_lex(T.CERTAIN)})::BIGINT AS certain, sum({_lex(T.VAGUE)})::BIGINT AS vague
FROM (SELECT text, role FROM conversations UNION ALL SELECT text, lang FROM documents) GROUP BY ALL"""


def sanitized_answers(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("See `GenerarPlan` and `a b`, "), F.initcap(F.regexp_replace(F.substring("text", 1, 30), r"[^\w]+", ".")), F.lit(" [Foo(1)] ```x\ny``` snake_case_id AbcDef.")).alias("answer"))
    return c.select("conv_id", "turn", T.sanitize(F.col("answer"), "(code)", "(id)").alias("clean"))


def strip_entity_prefix(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(T.strip_entity_prefix(F.concat(F.col("source"), F.lit(": "), F.col("text"))), 256).alias("h"))


STRIP_ENTITY_PREFIX = "SELECT doc_id, sha256(regexp_replace(source || ': ' || text, '^\\s*[^\\n:]{1,80}:\\s*', '')) AS h FROM documents"


def prompt_family(spark, sf):
    g = documents(spark, sf).groupBy("source").agg(F.count_if(F.col("lang") != "en").alias("docs"), F.count("*").alias("n"), F.min("doc_id").alias("m"))
    return g.select("source", X.prompt_family(F.col("docs"), F.col("n"), F.col("m") % 5 == 0, F.when(F.col("m") % 7 == 0, "code")).alias("family"))


PROMPT_FAMILY = """SELECT source, CASE WHEN m % 5 = 0 THEN 'simple' WHEN m % 7 = 0 THEN 'code' WHEN docs * 2 >= n THEN 'docs' ELSE 'code' END AS family FROM (SELECT source, count(*) FILTER (lang <> 'en') AS docs, count(*) AS n, min(doc_id) AS m FROM documents GROUP BY source)"""


def confidence_gate(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 100 / 100.0).cast("double").alias("s"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(5).alias("n"), F.when(F.col("event_id") % 3 == 0, "Rrf").otherwise("Cosine").alias("scale"))
    return e.select("event_id", X.assess(F.col("s"), F.col("n"), F.col("scale"), 0.05, 0.6).alias("band"))


CONFIDENCE_GATE = "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 100 < 5 THEN 'none' WHEN event_id % 100 < 60 THEN 'mid' ELSE 'high' END AS band FROM events"


def _arms(spark, sf):
    return (table(spark, sf, "labels").where(f"doc_id % {m} <> 0").select("doc_id", (F.col("doc_id") % n < 3).alias("hit")) for m, n in ((17, 5), (19, 7)))


def ab_compare(spark, sf):
    return E.compare_arms(*_arms(spark, sf), "doc_id", "hit")


_AB = """ab AS (SELECT CASE WHEN a.doc_id IS NULL THEN 'only_b' WHEN b.doc_id IS NULL THEN 'only_a' WHEN NOT a.hit AND b.hit THEN 'gained' WHEN a.hit AND NOT b.hit THEN 'lost' WHEN a.hit THEN 'kept' ELSE 'missed' END AS kind
 FROM (SELECT doc_id, doc_id % 5 < 3 AS hit FROM labels WHERE doc_id % 17 <> 0) a FULL JOIN (SELECT doc_id, doc_id % 7 < 3 AS hit FROM labels WHERE doc_id % 19 <> 0) b USING (doc_id))"""
AB_COMPARE = f"WITH {_AB} SELECT kind, count(*) AS n FROM ab GROUP BY kind"


def nightly_gate(spark, sf):
    return E.regression_verdict(ab_compare(spark, sf))


NIGHTLY_GATE = f"WITH {_AB}, t AS (SELECT count(*) FILTER (kind = 'lost') - count(*) FILTER (kind = 'gained') AS net_lost, count(*) FILTER (kind IN ('only_a', 'only_b')) AS uncovered FROM ab) SELECT net_lost, uncovered, CASE WHEN uncovered > 0 THEN 'incomparable' WHEN net_lost > 1 THEN 'regression' ELSE 'pass' END AS verdict FROM t"


def paired_calibration(spark, sf):
    """Two calibrations over the same labelled rows: accepted if no fabrication is new and no fewer answers are right."""
    g = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("present"), (F.col("doc_id") % 100 / 100.0).cast("double").alias("s"))
    a, b = F.col("s") >= 0.3, F.col("s") >= 0.4
    right = lambda x: (x & F.col("present")) | (~x & ~F.col("present"))
    out = g.agg(F.count_if(b & ~F.col("present") & ~a).alias("new_fabrications"), F.count_if(right(a)).alias("correct_a"), F.count_if(right(b)).alias("correct_b"))
    return out.withColumn("accepted", (F.col("new_fabrications") == 0) & (F.col("correct_b") >= F.col("correct_a")))


PAIRED_CALIBRATION = """WITH g AS (SELECT quality = 1 AS present, doc_id % 100 >= 30 AS a, doc_id % 100 >= 40 AS b FROM labels), t AS (SELECT count(*) FILTER (b AND NOT present AND NOT a) AS new_fabrications, count(*) FILTER (a = present) AS correct_a, count(*) FILTER (b = present) AS correct_b FROM g)
SELECT *, new_fabrications = 0 AND correct_b >= correct_a AS accepted FROM t"""


def provenance_diff(spark, sf):
    d = documents(spark, sf)
    a = d.groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    b = d.where("lang <> 'es' and source <> 'src3'").groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return E.provenance_diff(a, b)


PROVENANCE_DIFF = """SELECT * FROM (SELECT source AS key, count(*)::VARCHAR AS baseline FROM documents GROUP BY source) FULL JOIN (SELECT source AS key, count(*)::VARCHAR AS current FROM documents WHERE lang <> 'es' AND source <> 'src3' GROUP BY source) USING (key) WHERE baseline IS DISTINCT FROM current"""


def replica_determinism(spark, sf):
    """Signatures of a ranked list from three derivations of the same rows: one distinct signature a query."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    runs = [R.dense_topk(q, x, 5).groupBy("query_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string")), ","), 256).alias("sig")) for x in (v, v.repartition(3), v.orderBy(F.desc("id")))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("query_id").agg(F.count("*").alias("replicas"), F.count_distinct("sig").alias("signatures"))


REPLICA_DETERMINISM = f"""WITH {Q.dense(5)}, other AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, id) AS r FROM dense_scores),
s AS (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS sig FROM dense GROUP BY 1 UNION ALL SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY r) FROM other WHERE r <= 5 GROUP BY 1 UNION ALL SELECT query_id, array_to_string(list_transform(list_sort(list((-score, id)))[1:5], lambda x: x[2]), ',') FROM dense_scores GROUP BY 1)
SELECT query_id, count(*) AS replicas, count(DISTINCT sig) AS signatures FROM s GROUP BY 1"""


def latency_percentiles(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    stats = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(E.nearest_rank("value", 0.95), 6).alias("p95_rank"), F.round(E.interpolated("value", 0.95), 6).alias("p95_linear"), F.round(E.interpolated("value", 0.5), 6).alias("p50"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    return stats.join(E.banker_rank(e, "event_type", "value", "event_id").withColumn("p95_banker", F.round("p95_banker", 6)), "event_type")


LATENCY_PERCENTILES = """SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.95), 6) AS p95_rank, round(quantile_cont(value, 0.95), 6) AS p95_linear, round(quantile_cont(value, 0.5), 6) AS p50, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most,
 round(list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1], 6) AS p95_banker FROM events WHERE value IS NOT NULL GROUP BY event_type"""


def auth_visibility(spark, sf):
    """Customers are actors (market segment a scope, nation a tenant); regions are collections with required scopes and tenants."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("actor"), F.array("c_mktsegment").alias("scopes"), F.col("c_nationkey").cast("string").alias("tenant"), (F.col("c_custkey") % 50 == 0).alias("admin"))
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_set(F.col("n_nationkey").cast("string")).alias("tenants"))
    r = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("k")).select(F.col("r_name").alias("collection"), (F.col("r_regionkey") != 4).alias("published"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("required"), F.when(F.col("r_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.col("tenants")).alias("tenants"))
    ok = A.may_read(F.col("admin"), F.col("published"), F.col("scopes"), F.col("required"), F.col("tenant"), F.col("tenants"))
    return c.join(F.broadcast(r), ok).groupBy("collection").agg(F.count("*").alias("actors"), F.min("actor").alias("first"))  # r: five regions


AUTH_VISIBILITY = """WITH r AS (SELECT r_name AS collection, r_regionkey AS k FROM region)
SELECT collection, count(*) AS actors, min(c_custkey) AS first FROM customer, r WHERE c_custkey % 50 = 0 OR (k <> 4 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND (k = 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = k))) GROUP BY collection"""


def actor_claims(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("actor"), F.when(F.col("turn") % 2 == 0, "scope").otherwise("tenant").alias("kind"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("value"))
    return A.actors(c).select("actor", F.array_join("scopes", ",").alias("scopes"), "tenant")


ACTOR_CLAIMS = """SELECT conv_id::VARCHAR AS actor, coalesce(string_agg(DISTINCT CASE WHEN turn % 2 = 0 THEN role END, ',' ORDER BY CASE WHEN turn % 2 = 0 THEN role END), '') AS scopes,
 CASE WHEN count(DISTINCT CASE WHEN turn % 2 <> 0 THEN turn % 3 END) = 1 THEN max(CASE WHEN turn % 2 <> 0 THEN 't' || (turn % 3) END) END AS tenant FROM conversations GROUP BY conv_id"""


def effective_defaults(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    profile = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("top_k"))
    out = e.join(profile, "event_type").select("event_id", A.effective(F.when(F.col("k") > 5, F.col("k")), F.when(F.col("top_k") < 100, F.col("top_k")), A.TOP_K).cast("long").alias("top_k"))
    return out.withColumn("error", A.parameter_error(F.col("top_k"), F.lit(0.1)))


EFFECTIVE_DEFAULTS = """WITH e AS (SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events), p AS (SELECT event_type, count(*) FILTER (value > 50) AS n FROM events GROUP BY event_type),
t AS (SELECT event_id, coalesce(CASE WHEN k > 5 THEN k END, CASE WHEN n < 100 THEN n END, 10)::BIGINT AS top_k FROM e JOIN p USING (event_type)) SELECT event_id, top_k, CASE WHEN NOT top_k BETWEEN 1 AND 100 THEN 'topK' END AS error FROM t"""

RULES = ["# rules", "*.tmp", "fr/", "!**/fr/8*", "/blog.*", "**/6??", "en/7*#top", "!/thth*"]


def ignore_rules(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select("page_id", "path", L.ignored(F.col("path"), L.parse_rules(RULES)).alias("ignored"))


def _ignored_sql() -> str:
    hit = "CASE" + "".join(f" WHEN {'false' if only else f'''regexp_matches(p, '{rx}')'''} OR len(list_filter(above, lambda a: regexp_matches(a, '{rx}'))) > 0 THEN {'false' if neg else 'true'}" for _, rx, neg, only in reversed(L.parse_rules(RULES))) + " ELSE false END"
    return f"""WITH c AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), d AS (SELECT *, regexp_replace(regexp_replace(path, '^[./]+', ''), '/+$', '') AS p FROM c),
e AS (SELECT *, list_transform(range(1, len(string_split(p, '/'))), lambda i: array_to_string(string_split(p, '/')[1:i], '/')) AS above FROM d) SELECT page_id, path, {hit} AS ignored FROM e"""


IGNORE_RULES = _ignored_sql()


def module_boundary(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")).withColumn("root", F.element_at(F.split("path", "/"), 1))
    mods = p.groupBy("root").agg(F.min("path").alias("module"))
    return p.join(mods, "root").where(R.module_boundary(F.col("path"), F.col("module"), "/") | R.module_boundary(F.col("path"), F.concat(F.col("root"), F.lit("/a")), "/")).select("page_id", "root")


MODULE_BOUNDARY = """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), r AS (SELECT *, string_split(path, '/')[1] AS root FROM p), m AS (SELECT root, min(path) AS module FROM r GROUP BY root)
SELECT page_id, root FROM r JOIN m USING (root) WHERE path = module OR starts_with(path, module || '/') OR path = root || '/a' OR starts_with(path, root || '/a/')"""


def dedupe_first_seen(spark, sf):
    first = Window.partitionBy("h").orderBy("doc_id")
    d = documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    return d.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "h")


DEDUPE_FIRST_SEEN = "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY sha256(text)"


def capacity_projection(spark, sf):
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("machine"), F.when(F.col("s_suppkey") % 3 != 0, F.abs("s_acctbal").cast("double")).alias("rate"), (F.abs("s_acctbal") / 7 + 1).cast("double").alias("copy"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("size"))
    return E.capacity(m)


CAPACITY_PROJECTION = """WITH m AS (SELECT s_suppkey AS machine, CASE WHEN s_suppkey % 3 <> 0 THEN abs(s_acctbal)::DOUBLE END AS rate, (abs(s_acctbal) / 7 + 1)::DOUBLE AS copy, (s_suppkey % 5 + 1)::DOUBLE AS size FROM supplier),
e AS (SELECT machine, size * coalesce(rate, copy * (SELECT quantile_cont(rate / copy, 0.5) FROM m WHERE rate IS NOT NULL)) AS estimate FROM m) SELECT machine, round(estimate, 4) AS estimate, round(estimate / (SELECT max(estimate) FROM e), 6) AS relative FROM e"""


def schema_status(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    dense = F.when(F.col("k") % 5 != 0, F.map_from_arrays(F.when(F.col("k") % 3 == 0, F.array(F.lit("dense"), F.lit("dense-resumen"))).otherwise(F.array(F.lit("dense"), F.lit("x"))), F.array(F.when(F.col("k") % 7 == 0, 256).otherwise(384), F.lit(384))))
    sparse = F.when(F.col("k") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("sparse")))
    return n.select("k", S.schema_status(dense, sparse, F.lit(384)).alias("status"))


SCHEMA_STATUS = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 7 = 0 OR n_nationkey % 11 = 0 THEN 'Incompatible' WHEN n_nationkey % 3 <> 0 THEN 'Legacy' ELSE 'Current' END AS status FROM nation"


def summary_cache(spark, sf):
    d = documents(spark, sf).select("doc_id", I.content_hash(F.col("text")).alias("h"))
    cache = d.where("doc_id % 3 = 0").groupBy("h").agg((F.min("doc_id") % 2 == 0).alias("negative"))
    return d.join(cache.withColumnRenamed("h", "ch"), F.col("h") == F.col("ch"), "left").select("doc_id", X.cache_state(F.col("ch"), F.col("negative")).alias("state"))


SUMMARY_CACHE = """WITH c AS (SELECT sha256(text) AS h, min(doc_id) % 2 = 0 AS negative FROM documents WHERE doc_id % 3 = 0 GROUP BY sha256(text))
SELECT doc_id, CASE WHEN h IS NULL THEN 'miss' WHEN negative THEN 'negative' ELSE 'hit' END AS state FROM documents LEFT JOIN c ON h = sha256(text)"""


def worst_status(spark, sf):
    return E.worst_status(table(spark, sf, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])


WORST_STATUS = "SELECT o_custkey, min(o_orderpriority) AS worst FROM orders GROUP BY o_custkey"


def snapshot_digest(spark, sf):
    return S.snapshot_digest(documents(spark, sf).select("doc_id", "lang", "source"), "doc_id", ["doc_id", "lang", "source"])


SNAPSHOT_DIGEST = """WITH r AS (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS h FROM documents), a AS (SELECT substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1),
b AS (SELECT substr(b, 1, 2) AS b, sum(n) AS n, sha256(string_agg(h, '' ORDER BY b)) AS h FROM a GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM b"""


def redacted_sources(spark, sf):
    d = documents(spark, sf).select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "Technical").otherwise("Simple").alias("mode"), (F.col("lang") == "en").alias("prose"), F.lit(7).alias("line"))
    return d.select("doc_id", X.redact_source(F.col("mode"), F.col("prose"), F.col("source"), "path").alias("path"), X.redact_source(F.col("mode"), F.col("prose"), F.col("line"), "line").cast("long").alias("line"))


REDACTED_SOURCES = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR lang = 'en' THEN source END AS path, CASE WHEN doc_id % 2 = 0 THEN 7::BIGINT END AS line FROM documents"


def eval_targets(spark, sf):
    """Items against pages: the page's base name is one of the item's files and its text holds the anchor."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("base"), "html")
    want = table(spark, sf, "benchmark").select("item_id", F.explode(F.transform(F.sequence(F.col("item_id") * 5, F.col("item_id") * 5 + 9), lambda n: n.cast("string"))).alias("file"), F.split("text", " ")[1].alias("anchor"))
    hit = p.join(want, F.col("base") == F.col("file"))
    return hit.select("item_id", "page_id", (F.instr(F.lower("html"), F.lower(F.col("anchor"))) > 0).alias("anchored"))


EVAL_TARGETS = """SELECT item_id, page_id, instr(lower(html), lower(string_split(text, ' ')[2])) > 0 AS anchored FROM pages JOIN (SELECT item_id, text, unnest(range(item_id * 5, item_id * 5 + 10)) AS f FROM benchmark) ON regexp_extract(url, '/([0-9]+)', 1) = f::VARCHAR"""

QUERIES = {name.lower(): (f, globals().get(name.upper())) for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
