"""Registered queries: filters, hooks, evaluation details, graph upkeep, renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import access as A
from cairn.operators import census as N
from cairn.operators import context as X
from cairn.operators import evaluation as E
from cairn.operators import retrieval as R
from cairn.operators import store as S
from cairn.sources import files as L

from . import sql as Q
from .search import documents, table


def language_map(spark, sf):
    exts = F.element_at(F.array(*map(F.lit, [".cs", ".TS", ".md", ".exe", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    d = documents(spark, sf).select("doc_id", F.concat(F.col("source"), F.when(F.col("doc_id") % 4 == 0, "/Bin/f").otherwise("/a/f"), exts).alias("path"))
    return d.select("doc_id", L.language(F.col("path")).alias("language"), L.in_skipped_dir(F.col("path")).alias("skipped"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANGUAGES.items())
LANGUAGE_MAP = f"""WITH p AS (SELECT doc_id, source || CASE WHEN doc_id % 4 = 0 THEN '/Bin/f' ELSE '/a/f' END || ['.cs', '.TS', '.md', '.exe', ''][(doc_id % 5 + 1)::BIGINT] AS path FROM documents)
SELECT doc_id, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) {_CASES} ELSE 'Unknown' END AS language, len(list_intersect(list_transform(string_split(path, '/')[:-2], lambda x: lower(x)), [{Q.quoted(L.SKIPPED_DIRS)}])) > 0 AS skipped FROM p"""


def batch_lookup(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang")
    return R.lookup(d, table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id")


BATCH_LOOKUP = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def scroll_pages(spark, sf):
    return R.pages(documents(spark, sf).select("doc_id", "source"), "source", "doc_id", 7).groupBy("source", "page").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


SCROLL_PAGES = "SELECT source, (rn - 1) // 7 AS page, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY ALL"


def metadata_filters(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("language"), F.concat(F.lit("app."), F.col("source")).alias("namespace"), F.concat(F.lit("app/"), F.col("source")).alias("path"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"))).alias("tenant"))
    return R.metadata_filter(d, language="en", namespace="src1", tenant="t1", modules=["app"]).select("doc_id", "namespace")


METADATA_FILTERS = "SELECT doc_id, 'app.' || source AS namespace FROM documents WHERE lang = 'en' AND contains(source, 'src1') AND doc_id % 3 <> 0 AND doc_id % 2 = 1"


def qualified_hop(spark, sf):
    """Every fiftieth document asks for the documents of its source whose first line defines a term that its own first line has."""
    first = F.element_at(F.split("text", "\n", 2), 1)
    c = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("class_name"), F.array_distinct(T.terms(first)).alias("defined"))
    asked = c.where("id % 50 = 0").select(F.col("id").alias("query_id"), "class_name", F.explode("defined").alias("method"))
    return R.qualified_hop(c, asked).where("id <> query_id").select("query_id", "id")


QUALIFIED_HOP = f"""WITH {Q.terms('def', 'documents', 'doc_id', "split_part(text, chr(10), 1)")}, c AS (SELECT DISTINCT id, source, term FROM def JOIN documents ON doc_id = id)
SELECT DISTINCT a.id AS query_id, b.id AS id FROM c a JOIN c b USING (source, term) WHERE a.id % 50 = 0 AND a.id <> b.id"""


def symbol_filter(spark, sf):
    wanted = F.array(*map(F.lit, ["ering", "tion", "ster", "escion"]))
    c = documents(spark, sf).select(F.col("source").alias("class_name"), F.array_distinct(T.terms(F.col("text"))).alias("defined"))
    return c.where(R.defines_any(F.col("defined"), wanted)).groupBy("class_name").agg(F.count("*").alias("n"))


SYMBOL_FILTER = f"WITH {Q.terms('post', 'documents', 'doc_id', 'text')} SELECT source AS class_name, count(DISTINCT id) AS n FROM post JOIN documents ON doc_id = id WHERE term IN ('ering', 'tion', 'ster', 'escion') GROUP BY source"


def retrieval_profile(spark, sf):
    """Fusion overrides of a profile, null keeping the default."""
    n = table(spark, sf, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 10.0).cast("double").alias("sparse"), F.when(F.col("n_nationkey") % 3 == 0, 30).alias("k"))
    return n.select("n_name", A.effective(F.col("sparse"), F.lit(None).cast("double"), R.WEIGHTS["sparse"]).alias("sparse_weight"), A.effective(F.col("k"), F.lit(None).cast("int"), R.RANK_CONSTANT).cast("long").alias("constant"))


RETRIEVAL_PROFILE = "SELECT n_name, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 10.0::DOUBLE END, 1.3)::DOUBLE AS sparse_weight, CASE WHEN n_nationkey % 3 = 0 THEN 30 ELSE 60 END::BIGINT AS constant FROM nation"


def logged_questions(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    shown = X.visible_question(F.col("text"), F.col("conv_id") % 2 == 0, F.when(F.col("conv_id") % 3 != 0, F.when(F.col("conv_id") % 5 == 0, ts("2020-01-01")).otherwise(ts("2030-01-01"))), ts("2025-01-01"))
    return c.select("conv_id", "turn", F.sha2(shown, 256).alias("h"))


LOGGED_QUESTIONS = "SELECT conv_id, turn, sha256(CASE WHEN conv_id % 2 = 0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0 THEN text ELSE 'len=' || length(text) END) AS h FROM conversations WHERE role = 'user'"


def target_suffix_match(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"), "html")
    anchors = F.when(F.col("page_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("THE "), F.lit("zzzz")))
    return p.where(E.matches_target(F.col("path"), F.col("html"), F.when(F.col("page_id") % 2 == 0, "5").otherwise("/"), anchors)).select("page_id")


TARGET_SUFFIX_MATCH = "SELECT page_id FROM pages WHERE ends_with(lower(regexp_replace(url, '[?#].*$', '')), CASE WHEN page_id % 2 = 0 THEN '5' ELSE '/' END) AND (page_id % 3 = 0 OR contains(lower(html), 'the ') OR contains(lower(html), 'zzzz'))"


def anchor_verification(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("file"), "text")
    first = F.split("text", " ")[0]
    anchors = d.select((F.col("file") * 1).alias("item"), F.when(F.col("file") % 7 == 0, -1).otherwise(F.col("file")).alias("file"), F.when(F.col("file") % 5 == 0, "§").otherwise(first).alias("anchor"))
    chunks = d.where("file % 3 <> 0").select("file", F.when(F.col("file") % 2 == 0, F.col("text")).otherwise("-").alias("content"))
    return E.anchor_status(anchors, d, chunks)


ANCHOR_VERIFICATION = """SELECT doc_id AS item, CASE WHEN doc_id % 7 = 0 THEN 'no_file' WHEN doc_id % 5 = 0 THEN 'not_in_file' WHEN doc_id % 3 = 0 THEN 'not_indexed' WHEN doc_id % 2 <> 0 AND NOT contains('-', string_split(text, ' ')[1]) THEN 'not_in_chunk' ELSE 'ok' END AS status FROM documents"""


def precision_with_abstention(spark, sf):
    o = table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("opportunity"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 37).alias("predicted"), (F.col("event_id") % 74).alias("target"))
    return E.precision_without_reuse(o)


PRECISION_WITH_ABSTENTION = """WITH c AS (SELECT user_id AS q, event_id AS o, CASE WHEN event_id % 4 <> 0 THEN event_id % 37 END AS p, event_id % 74 AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY q, p ORDER BY o) AS n FROM c)
SELECT count(p) AS given, count(*) FILTER (n = 1 AND p = t) AS correct, count(*) FILTER (p IS NULL) AS abstained, count(*) FILTER (p IS NOT NULL AND n > 1) AS reused FROM r"""


def new_ids_by_arm(spark, sf):
    """What a second arm's lists hold that the first's do not, by query."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    ids = lambda d, name: d.groupBy("query_id").agg(F.collect_set("id").alias(name))
    both = ids(R.dense_topk(q, v, 10), "a").join(ids(R.dense_topk(q, v, 10, same="label"), "b"), "query_id", "full")
    return both.select("query_id", F.size(F.array_except("b", "a")).cast("long").alias("new_ids"), F.size(F.array_intersect("a", "b")).cast("long").alias("kept_ids"), F.size(F.array_except("a", "b")).cast("long").alias("gone_ids"))


NEW_IDS_BY_ARM = f"""WITH {Q.dense(10)}, s2 AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense_scores s JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = id WHERE q.label = d.label), b AS (SELECT query_id, id FROM s2 WHERE rank <= 10)
SELECT query_id, count(*) FILTER (a.id IS NULL) AS new_ids, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS kept_ids, count(*) FILTER (b.id IS NULL) AS gone_ids FROM (SELECT query_id, id FROM dense) a FULL JOIN b USING (query_id, id) GROUP BY query_id""".replace("a.id IS NULL", "a.k IS NULL").replace("a.id IS NOT NULL AND b.id IS NOT NULL", "a.k IS NOT NULL AND b.k IS NOT NULL").replace("b.id IS NULL", "b.k IS NULL").replace("(SELECT query_id, id FROM dense) a FULL JOIN b", "(SELECT query_id, id, 1 AS k FROM dense) a FULL JOIN (SELECT query_id, id, 1 AS k FROM b) b")


def meta_intent(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return E.meta_intent(v.withColumnRenamed("id", "query_id"), v.where("id < 24"), 0.4).select("query_id", F.round("best", 6).alias("best"), "is_meta")


META_INTENT = "SELECT query_id, round(best, 6) AS best, best >= 0.4 AS is_meta FROM (SELECT q.vec_id AS query_id, max(round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9)) AS best FROM embeddings q, (SELECT * FROM embeddings WHERE vec_id < 24) e GROUP BY q.vec_id)"


def arm_costs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("arm")).agg(F.count_distinct("user_id").alias("queries"), F.count("*").alias("candidates"), F.round(F.max("value"), 6).alias("slowest"))


ARM_COSTS = "SELECT event_type AS arm, count(DISTINCT user_id) AS queries, count(*) AS candidates, round(max(value), 6) AS slowest FROM events GROUP BY 1"


def answer_quality(spark, sf):
    """Answers of the assistant, one in four made to refuse and one in four to hedge."""
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("No tengo acceso a eso. "), F.col("text"))).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("No encontré una coincidencia clara. "), F.col("text"))).otherwise(F.col("text"))
    c = table(spark, sf, "conversations").where("role = 'assistant'").select(said.alias("text"))
    c = c.select(T.stance(F.col("text")).alias("stance"), F.length("text").alias("n"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"))
    return c.groupBy("stance").agg(F.count("*").alias("n"), F.round(F.avg("n"), 1).alias("mean_chars"), F.round(F.percentile("w", 0.5), 1).alias("median_words"), F.round(100 * F.count_if(F.col("w") > 20) / F.count("*"), 1).alias("long_share"))


def _has(marks: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{m}')" for m in marks)


ANSWER_QUALITY = f"""WITH c AS (SELECT CASE conv_id % 4 WHEN 0 THEN 'No tengo acceso a eso. ' WHEN 1 THEN 'No encontré una coincidencia clara. ' ELSE '' END || text AS text FROM conversations WHERE role = 'assistant'),
w AS (SELECT CASE WHEN {_has(T.REFUSALS)} THEN 'rechazo_pleno' WHEN {_has(T.HEDGES)} THEN 'banda_baja' ELSE 'directo' END AS stance, length(text) AS n, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM c)
SELECT stance, count(*) AS n, round(avg(n), 1) AS mean_chars, round(quantile_cont(w, 0.5), 1)::DOUBLE AS median_words, round(100.0::DOUBLE * count(*) FILTER (w > 20) / count(*), 1) AS long_share FROM w GROUP BY stance"""


def recall_any_full(spark, sf):
    """Benchmark items ask all documents by shared terms; two words of an item are its anchors, a document outside src1 its target."""
    items = table(spark, sf, "benchmark")
    d = documents(spark, sf)
    near = R.sparse_topk(R.postings(items, "item_id", "text"), d, 10, "doc_id", "text", itself=True)
    hits = near.join(d.select(F.col("doc_id").alias("id"), (F.col("source") != "src1").alias("is_target"), F.col("text").alias("content")), "id").select(F.col("query_id").alias("item"), "rank", "is_target", "content")
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    asked = items.select(F.col("item_id").alias("item"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.filter(F.array(word(1), word(4)), lambda w: F.length(w) > 0).alias("anchors"), (F.col("item_id") % 5 == 0).alias("ambiguous"))
    return E.recall_by_anchor(hits, asked)


RECALL_ANY_FULL = f"""WITH {Q.terms('post', 'documents', 'doc_id', 'text')}, {Q.terms('ask', 'benchmark', 'item_id', 'text')},
s AS (SELECT a.id AS item, p.id AS id, round(sum(a.weight * p.weight), 9) AS score FROM ask a JOIN post p USING (term) GROUP BY ALL),
h AS (SELECT item, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rank FROM s) JOIN documents ON doc_id = id WHERE rank <= 10 AND source <> 'src1'),
i AS (SELECT item_id AS item, 'c' || item_id % 3 AS category, list_distinct(list_filter([string_split(text, ' ')[2], string_split(text, ' ')[5]], lambda x: length(x) > 0)) AS anchors, item_id % 5 = 0 AS ambiguous FROM benchmark),
e AS (SELECT item, category, ambiguous, unnest(anchors) AS anchor, k FROM i, (SELECT unnest([1, 3, 5, 10])::BIGINT AS k)),
g AS (SELECT e.item, category, ambiguous, k, anchor, coalesce(max((contains(text, anchor) AND rank <= k)::INT), 0) AS got FROM e LEFT JOIN h USING (item) GROUP BY ALL),
f AS (SELECT item, category, ambiguous, k, max(got) AS a, min(got) AS f FROM g GROUP BY ALL)
SELECT category, k, count(*) AS items, round(avg(a), 6) AS any_rate, round(avg(f), 6) AS full_rate FROM (SELECT category, k, a, f FROM f UNION ALL SELECT 'TOTAL', k, a, f FROM f UNION ALL SELECT 'AMBIGUOUS', k, a, f FROM f WHERE ambiguous) GROUP BY ALL"""


def audit_hold_purge(spark, sf):
    """Holds are set and cleared, then what is older than a week and not under hold goes."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", (F.col("user_id") % 10 == 0).alias("legal_hold"))
    change = lambda where, on, at: e.where(where).select("event_id", F.lit(on).alias("legal_hold"), F.lit(at).alias("at"))
    changes = change("event_id % 7 = 0", True, 1).unionByName(change("event_id % 14 = 0", False, 2))
    cut = e.agg(F.expr("max(ts) - interval 7 days").alias("cutoff"))  # one row
    left = S.purge(S.set_hold(e, changes, "event_id").join(F.broadcast(cut)), "ts", F.col("cutoff"))
    return left.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("legal_hold").alias("held"), F.count_if(F.col("ts") < F.col("cutoff")).alias("old"))


AUDIT_HOLD_PURGE = """WITH e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 14 = 0 THEN false WHEN event_id % 7 = 0 THEN true ELSE user_id % 10 = 0 END AS hold FROM events), c AS (SELECT max(ts) - INTERVAL 7 DAY AS c FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (hold) AS held, count(*) FILTER (ts < c) AS old FROM e, c WHERE ts >= c OR hold GROUP BY event_type"""


def ask_contexts(spark, sf):
    """Questions from vector to context: meta-intent, search, gate, budget."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    ranked = R.dense_topk(q, v, 10).withColumn("scale", F.lit("Cosine"))
    meta = E.meta_intent(q, v.where("id < 24"), 0.4).select("query_id", "is_meta")
    return X.ask(q, meta, ranked, d, 0.25, 0.45, 6000).select("query_id", "band", "route", F.array_join("sources", ",").alias("sources"), F.sha2("context", 256).alias("context_hash"), "note")


_META = "SELECT q.vec_id AS query_id, max(round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9)) >= 0.4 AS is_meta FROM embeddings q, (SELECT * FROM embeddings WHERE vec_id < 24) e WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id"
ASK_CONTEXTS = f"""WITH RECURSIVE {Q.dense(10)}, m AS ({_META}),
b AS (SELECT query_id, max(score) AS top FROM dense GROUP BY query_id),
r AS (SELECT query_id, is_meta, CASE WHEN top < 0.25::DOUBLE THEN 'none' WHEN top < 0.45::DOUBLE THEN 'mid' ELSE 'high' END AS band FROM m JOIN b USING (query_id)),
t AS (SELECT query_id, band, CASE WHEN is_meta THEN 'meta' WHEN band = 'none' THEN 'declined' ELSE 'grounded' END AS route FROM r),
x AS (SELECT query_id, id, text, length(text) AS n, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM t JOIN dense USING (query_id) JOIN documents ON doc_id = id WHERE route = 'grounded'),
f AS (SELECT query_id, id, text, k, n + 7 <= 6000 AS ok, CASE WHEN n + 7 <= 6000 THEN n ELSE 0 END AS used FROM x WHERE k = 1
 UNION ALL SELECT x.query_id, x.id, x.text, x.k, f.used + x.n + 7 <= 6000, CASE WHEN f.used + x.n + 7 <= 6000 THEN f.used + x.n + CASE WHEN f.used > 0 THEN 7 ELSE 0 END ELSE f.used END FROM f JOIN x ON x.query_id = f.query_id AND x.k = f.k + 1),
g AS (SELECT query_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (ok), '') AS sources, sha256(coalesce(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) FILTER (ok), '')) AS context_hash, CASE WHEN count(*) FILTER (ok) < count(*) THEN '[' || count(*) FILTER (NOT ok) || ' of ' || count(*) || ' results left out]' END AS note FROM f GROUP BY query_id)
SELECT query_id, band, route, sources, context_hash, note FROM t LEFT JOIN g USING (query_id)"""


def schema_problems(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    dense = F.when(F.col("k") % 5 != 0, F.map_from_arrays(F.when(F.col("k") % 3 == 0, F.array(F.lit("dense"), F.lit("dense-resumen"))).otherwise(F.array(F.lit("dense"), F.lit("x"))), F.array(F.when(F.col("k") % 7 == 0, 256).otherwise(384), F.when(F.col("k") % 2 == 0, 384).otherwise(512))))
    sparse = F.when(F.col("k") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("sparse")))
    return n.select("k", F.array_join(S.schema_problems(dense, sparse, F.lit(384)), "; ").alias("problems"))


SCHEMA_PROBLEMS = """SELECT n_nationkey AS k, concat_ws('; ', CASE WHEN n_nationkey % 5 = 0 THEN 'dense is missing' END, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 = 0 THEN 'dense has dimension 256, expected 384' END,
 CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 <> 0 THEN 'dense-resumen is missing' END, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0 AND n_nationkey % 2 <> 0 THEN 'dense-resumen has dimension 512, expected 384' END, CASE WHEN n_nationkey % 11 = 0 THEN 'sparse is missing' END) AS problems FROM nation"""


def manifest_json(spark, sf):
    """Manifests written as JSON and read again: the model's hash against the present one, and nested fields."""
    n = table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("collection"), F.sha2(F.col("n_regionkey").cast("string"), 256).alias("model_hash"), F.struct(F.col("n_regionkey").alias("dimension")).alias("profile"), F.array("n_name").alias("tenants"))).alias("doc"))
    m = n.select("n_nationkey", F.from_json("doc", "collection string, model_hash string, profile struct<dimension: long>, tenants array<string>").alias("m"))
    return m.select("n_nationkey", "m.collection", F.col("m.profile.dimension").alias("dimension"), F.size("m.tenants").cast("long").alias("tenants"), (F.col("m.model_hash") == F.sha2(F.lit("1"), 256)).alias("same_model"))


MANIFEST_JSON = """SELECT n_nationkey, n_name AS collection, n_regionkey::BIGINT AS dimension, 1::BIGINT AS tenants, sha256(n_regionkey::VARCHAR) = sha256('1') AS same_model FROM nation"""


def finite_scores(spark, sf):
    """Scores that pass the guard against what is not finite, and headers of their chunks."""
    e = table(spark, sf, "events").where("value is not null")
    return e.select("event_id", F.round(A.finite(F.col("value")), 6).alias("score"), T.chunk_header(F.col("event_type"), F.concat(F.lit("a/"), F.col("user_id").cast("string")), F.col("event_id"), F.col("event_id") + 9).alias("header"))


FINITE_SCORES = "SELECT event_id, round(value, 6) AS score, '// Repository: ' || event_type || chr(10) || '// File: a/' || user_id || chr(10) || '// Lines: ' || event_id || '-' || event_id + 9 AS header FROM events WHERE value IS NOT NULL"


def member_runs(spark, sf):
    return N.member_runs(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


MEMBER_RUNS = """WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS run FROM p)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run"""


def graph_replace(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("string").alias("document"))
    edges = d.alias("a").join(d.alias("b"), (F.col("a.node") + 1 == F.col("b.node")) | (F.col("a.node") + 5 == F.col("b.node"))).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    fresh = d.where("document = '1'").select((F.col("node") + 100).alias("node"), "document")
    links = fresh.select(F.col("node").alias("src"), F.lit(0).cast("long").alias("dst"))
    applied = table(spark, sf, "region").select(F.lower("r_name").alias("event"))
    _, once = N.replace_document(d, edges, applied, "e1", "1", fresh, links)
    _, replay = N.replace_document(d, edges, applied, "asia", "1", fresh, links)
    return once.withColumn("kind", F.lit("once")).unionByName(replay.withColumn("kind", F.lit("replay")))


GRAPH_REPLACE = """WITH d AS (SELECT n_nationkey::BIGINT AS node, n_regionkey AS document FROM nation), e AS (SELECT a.node AS src, b.node AS dst FROM d a JOIN d b ON a.node + 1 = b.node OR a.node + 5 = b.node), o AS (SELECT node FROM d WHERE document = 1)
SELECT src, dst, 'once' AS kind FROM e WHERE src NOT IN (FROM o) AND dst NOT IN (FROM o) UNION ALL SELECT node + 100, 0, 'once' FROM o UNION ALL SELECT src, dst, 'replay' FROM e"""


def pooled_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"), F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("mask"))
    return V.mean_pool(e, "label", "v", "mask").select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round(F.col("x") + 0.0, 5).alias("x"))


POOLED_VECTORS = """WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY label)
SELECT label::BIGINT AS label, i, round(x / z + 0.0::DOUBLE, 5) AS x FROM m JOIN n USING (label)"""


def sigmoid_scores(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", F.round(V.sigmoid(F.col("value") / 50 - 1), 6).alias("score"), T.score_text(F.floor(F.col("value")) / 100).alias("shown"))


SIGMOID_SCORES = "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 6) AS score, printf('%.2f', floor(value) / 100) AS shown FROM events WHERE value IS NOT NULL"


def calibration_validity(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10 / 10.0).cast("double").alias("low"), (F.col("c_custkey") % 7 / 5.0).cast("double").alias("high"), F.when(F.col("c_custkey") % 4 == 0, F.upper(F.sha2("c_name", 256))).otherwise(F.sha2("c_name", 256)).alias("identity"))
    return c.select("c_custkey", E.valid_calibration(F.col("low"), F.col("high"), F.col("identity")).alias("valid"))


CALIBRATION_VALIDITY = "SELECT c_custkey, c_custkey % 10 / 10.0 < c_custkey % 7 / 5.0 AND c_custkey % 7 / 5.0 <= 1 AND (c_custkey % 4 <> 0 OR upper(sha256(c_name)) = sha256(c_name)) AS valid FROM customer"


def located_passages(spark, sf):
    d = documents(spark, sf).select("doc_id", "text", F.regexp_replace(F.substring("text", 10, 25), r"\s+", "\n ").alias("needle"))
    return d.select("doc_id", T.locate_once(F.col("text"), F.col("needle")).alias("place"))


LOCATED_PASSAGES = """WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS h, regexp_replace(substr(text, 10, 25), '\\s+', '', 'g') AS n FROM documents)
SELECT doc_id, CASE WHEN n <> '' AND instr(h, n) > 0 AND instr(substr(h, instr(h, n) + 1), n) = 0 THEN (instr(h, n) - 1)::BIGINT END AS place FROM d"""


def normalised_texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("h"))


NORMALISED_TEXTS = f"SELECT doc_id, sha256(trim(regexp_replace(translate(lower(text), '{T.ACCENTS}', '{T.PLAIN}'), '\\s+', ' ', 'g'))) AS h FROM documents"


def contract_fingerprints(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("exts"))
    return n.select("n_regionkey", T.contract_fingerprint({"v": F.lit(1), "region": F.col("n_regionkey")}, F.col("exts")).alias("fingerprint"))


CONTRACT_FINGERPRINTS = "SELECT n_regionkey, 'v=1;region=' || n_regionkey || ';ext=' || string_agg(n_name, ',' ORDER BY n_name) AS fingerprint FROM nation GROUP BY n_regionkey"


def rendered_rows(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return L.to_json_rows(r).select(F.col("json").alias("line")).unionByName(L.to_markdown(r, ["key", "name"]))


RENDERED_ROWS = """SELECT '{"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS line FROM region UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region"""


def ancestor_types(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("type"), F.floor(F.col("p_partkey") / 2).cast("string").alias("base")).where("base <> '0'")
    return R.base_types(p, 3).groupBy("level").agg(F.count("*").alias("n"))


ANCESTOR_TYPES = """WITH b AS (SELECT p_partkey AS t, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 <> 0), l2 AS (SELECT x.t, y.b FROM b x JOIN b y ON y.t = x.b), l3 AS (SELECT x.t, y.b FROM l2 x JOIN b y ON y.t = x.b)
SELECT 1::BIGINT AS level, count(*) AS n FROM b UNION ALL SELECT 2, count(*) FROM l2 UNION ALL SELECT 3, count(*) FROM l3"""


def reranked(spark, sf):
    """The sparse pool scored anew by a stand-in for a cross-encoder, the share of query words that the text has."""
    from .search import _sparse

    def overlap(pairs):
        return [4 * len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(a.lower().split()))) - 2 for a, b in pairs]

    d = documents(spark, sf).select("doc_id", "text")
    pool = _sparse(spark, sf, 30).select("query_id", "id").join(d.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "content"), "id").join(d.withColumnRenamed("doc_id", "query_id").withColumnRenamed("text", "query"), "query_id")
    return R.rerank(pool, overlap, stable=True).where("rank <= 10")


def hashed_embeddings(spark, sf):
    e = V.embed(documents(spark, sf), "doc_id", "text", V.hashing_encoder(64), 64)
    return e.select("id", F.round(V.dot(F.col("v"), F.col("v")), 3).alias("norm"))


def summary_phase(spark, sf):
    from cairn.operators.summaries import groups, summarise

    d = documents(spark, sf).select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), F.col("source").alias("path"), F.col("lang").alias("class_name"), F.col("doc_id").alias("start_line"))
    wanted = groups(d, per_file=True)
    cache = wanted.where("group_key < '8'").select("group_key", F.lit("v1").alias("version"))
    return summarise(wanted, cache, "v1", lambda t: t[:40] if len(t) > 2000 else None)


QUERIES = {name.lower(): (f, globals().get(name.upper())) for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
