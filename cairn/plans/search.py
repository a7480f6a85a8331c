"""Registered queries: identity, lexing, exact and sparse search, fusion, hops, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import identity as I
from cairn.functions import text as T
from cairn.operators import evaluation as E
from cairn.operators import retrieval as R
from cairn.sources.tables import spread

from . import sql as Q

K = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _dense(spark, sf, k=K, **more) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return R.dense_topk(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v, k, **more)


def _sparse(spark, sf, k=K) -> DataFrame:
    """Every fiftieth document asks all others by shared terms; the queries alone are lexed for their postings."""
    d = documents(spark, sf)
    return R.sparse_topk(R.postings(d.where("doc_id % 50 = 0"), "doc_id", "text"), d, k, "doc_id", "text")


def content_identity(spark, sf):
    key = I.identity_key(F.col("source"), F.concat(F.col("lang"), F.lit("\\"), F.col("doc_id").cast("string")))
    return documents(spark, sf).select("doc_id", I.content_hash(F.col("text")).alias("content_hash"), key.alias("identity_key"), I.chunk_id(key, F.lit(1), I.content_hash(F.col("text"))).alias("chunk_id"), I.prompt_version(F.lit("v1"), F.col("lang"), F.col("source")).alias("prompt_version"), I.split_70_30(F.col("text")).alias("part"))


CONTENT_IDENTITY = f"""WITH d AS (SELECT doc_id, lang, source, text, sha256(text) AS content_hash, source || '/' || lang || '/' || doc_id AS identity_key FROM documents)
SELECT doc_id, content_hash, identity_key, {Q.uuid5("identity_key || ':1:' || content_hash")} AS chunk_id, substr(sha256('v1|' || lang || '|' || source), 1, 8) AS prompt_version,
 CASE WHEN ('0x' || substr(content_hash, 1, 2))::INT % 10 >= 7 THEN 'check' ELSE 'calibration' END AS part FROM d"""


def token_estimate_stats(spark, sf):
    d = documents(spark, sf).select("lang", F.length("text").alias("n"), T.token_estimate(F.col("text")).alias("tokens"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), E.nearest_rank("tokens", 0.5).cast("long").alias("p50"), E.nearest_rank("tokens", 0.95).cast("long").alias("p95"), F.round(E.interpolated("tokens", 0.95), 6).alias("p95_linear"), F.round(F.sum("n") / F.sum("tokens"), 6).alias("chars_per_token"))


TOKEN_ESTIMATE_STATS = """SELECT lang, count(*) AS n, quantile_disc(t, 0.5)::BIGINT AS p50, quantile_disc(t, 0.95)::BIGINT AS p95, round(quantile_cont(t, 0.95), 6)::DOUBLE AS p95_linear, round(sum(length(text)) / sum(t), 6)::DOUBLE AS chars_per_token
FROM (SELECT lang, text, ceil(length(text) / 4.0)::BIGINT AS t FROM documents) GROUP BY lang"""


def truncated_texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(T.truncate_to_tokens(F.col("text"), 64), 256).alias("cut_hash"), F.length(T.truncate_to_tokens(F.col("text"), 64)).cast("long").alias("n"))


_CUT = "CASE WHEN length(text) <= 256 THEN text ELSE coalesce(nullif(rtrim(regexp_extract(substr(text, 1, 256), '(?s)^(.*)\\s', 1)), ''), substr(text, 1, 256)) || '...' END"
TRUNCATED_TEXTS = f"SELECT doc_id, sha256(c) AS cut_hash, length(c)::BIGINT AS n FROM (SELECT doc_id, {_CUT} AS c FROM documents)"


def sparse_terms(spark, sf):
    return R.postings(documents(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "n", F.round("weight", 6).alias("weight"))


SPARSE_TERMS = f"WITH {Q.terms('post', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, term, n, round(weight, 6) AS weight FROM post"


def sparse_vector_hashed(spark, sf):
    post = R.postings(documents(spark, sf), "doc_id", "text")
    return T.with_bucket(post).groupBy(F.col("id").alias("doc_id"), "term_index").agg(F.round(F.sum("weight"), 6).alias("weight"))


_M = "4294967296"
_MIX = "((({k}::HUGEINT * 3432918353 % 4294967296 * 32768) % 4294967296 + ({k}::HUGEINT * 3432918353 % 4294967296) // 131072) * 461845907 % 4294967296)::BIGINT"
_PAIR = "(unicode(substr(term, 2 * i - 1, 1)) + unicode(substr(term, 2 * i, 1))::BIGINT * 65536)"
_BODY = f"list_reduce(list_concat([3735929054::BIGINT], list_transform(range(1, length(term) // 2 + 1), lambda i: {_MIX.format(k=_PAIR)})), lambda h, k: ((((xor(h, k)::HUGEINT * 8192) % {_M} + xor(h, k) // 524288) * 5 + 3864292196) % {_M})::BIGINT)"
_TAIL = _MIX.format(k="unicode(substr(term, length(term), 1))")
SPARSE_VECTOR_HASHED = f"""WITH {Q.terms('post', 'documents', 'doc_id', 'text')},
u AS (SELECT DISTINCT term FROM post), b AS (SELECT term, {_BODY} AS h FROM u),
t AS (SELECT term, xor(CASE WHEN length(term) % 2 = 1 THEN xor(h, {_TAIL}) ELSE h END, length(term)) AS h FROM b),
f1 AS (SELECT term, (xor(h, h // 65536)::HUGEINT * 2246822507 % {_M})::BIGINT AS h FROM t),
f2 AS (SELECT term, (xor(h, h // 8192)::HUGEINT * 3266489909 % {_M})::BIGINT AS h FROM f1),
f3 AS (SELECT term, xor(h, h // 65536) % 1048576 AS term_index FROM f2)
SELECT id AS doc_id, term_index, round(sum(weight), 6) AS weight FROM post JOIN f3 USING (term) GROUP BY ALL"""


def sparse_topk(spark, sf):
    return _sparse(spark, sf).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


SPARSE_TOPK = f"WITH {Q.sparse(K)} SELECT query_id, id, rank, round(score, 6) AS score FROM sparse"


def dense_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


DENSE_TOPK = f"WITH {Q.dense(K)} SELECT query_id, id, rank, round(score, 6) AS score FROM dense"


def dense_topk_min_score(spark, sf):
    return _dense(spark, sf, min_score=0.25).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


DENSE_TOPK_MIN_SCORE = f"WITH {Q.dense(K)} SELECT query_id, id, rank, round(score, 6) AS score FROM dense WHERE score >= 0.25"


def dense_topk_filtered(spark, sf):
    return _dense(spark, sf, same="label").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


DENSE_TOPK_FILTERED = f"WITH {Q.dense(K, ' AND d.label = q.label')} SELECT query_id, id, rank, round(score, 6) AS score FROM dense"


def rrf_native(spark, sf):
    return R.cut(R.fuse_native([_dense(spark, sf, 40), _sparse(spark, sf, 40)]), K).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


_NATIVE = "fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (rank + 1)), 9) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM sparse) GROUP BY ALL)"
_CUT_K = "SELECT query_id, id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= {k}"
RRF_NATIVE = f"WITH {Q.dense(40)}, {Q.sparse(40)}, {_NATIVE} {_CUT_K.format(k=K)}"


def rrf_weighted(spark, sf):
    return R.cut(R.fuse_weighted({"dense": _dense(spark, sf, 40), "sparse": _sparse(spark, sf, 40)}), K).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


_WEIGHTED = "fused AS (SELECT query_id, id, round(sum(w / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank, 1.0::DOUBLE AS w FROM dense UNION ALL SELECT query_id, id, rank, 1.3::DOUBLE AS w FROM sparse) GROUP BY ALL)"
RRF_WEIGHTED = f"WITH {Q.dense(40)}, {Q.sparse(40)}, {_WEIGHTED} {_CUT_K.format(k=K)}"


def hybrid_search(spark, sf):
    """Items of the benchmark ask all documents: by shared terms, and by the vectors that have the ids of item and document. The dense branch sees documents that have a vector."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    items, d = table(spark, sf, "benchmark"), documents(spark, sf)
    dense = R.dense_topk(items.join(v, items["item_id"] == v["id"]).select(F.col("item_id").alias("query_id"), "v"), v.join(d.select(F.col("doc_id").alias("id")), "id", "left_semi"), 40)
    sparse = R.sparse_topk(R.postings(items, "item_id", "text"), d, 40, "doc_id", "text", itself=True)
    best = R.cut(R.fuse_weighted({"dense": dense, "sparse": sparse}), K)
    # The texts come last, for what is returned only.
    return best.join(d.select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").cast("long").alias("n_chars")), "id", "left").select("query_id", "id", "rank", F.round("score", 9).alias("score"), "lang", "n_chars")


HYBRID_SEARCH = f"""WITH {Q.terms('post', 'documents', 'doc_id', 'text')}, {Q.terms('ask', 'benchmark', 'item_id', 'text')},
s1 AS (SELECT a.id AS query_id, p.id AS id, round(sum(a.weight * p.weight), 9) AS score FROM ask a JOIN post p USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s1) WHERE rank <= 40),
d1 AS (SELECT item_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e WHERE e.vec_id <> item_id AND e.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d1) WHERE rank <= 40),
{_WEIGHTED}, best AS ({_CUT_K.format(k=K)})
SELECT query_id, id, rank, score, lang, n_chars::BIGINT AS n_chars FROM best LEFT JOIN documents ON doc_id = id"""


def pool_sizes(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 20 + 1).alias("top_k"), (F.col("event_id") % 2 == 0).alias("rerank"), (F.col("event_id") % 3 == 0).alias("hop"))
    base, prefetch, final = R.pool_sizes(F.col("top_k"), F.col("rerank"), F.col("hop"))
    return e.select("event_id", base.cast("long").alias("base"), prefetch.cast("long").alias("prefetch"), final.cast("long").alias("final"))


POOL_SIZES = """SELECT event_id, base, greatest(4 * base, 40)::BIGINT AS prefetch, (CASE WHEN event_id % 3 = 0 AND event_id % 2 <> 0 THEN base + 20 ELSE base END)::BIGINT AS final
FROM (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END * (event_id % 20 + 1))::BIGINT AS base FROM events)"""


def _chunks(spark, sf) -> DataFrame:
    """(id, v, defined, consumed) of documents that have a vector: the terms of the first line are defined, those of the rest consumed, in their order."""
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.split("text", "\n", 2).alias("p"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return d.join(v, "id").select("id", "v", F.array_distinct(T.terms(F.element_at("p", 1))).alias("defined"), F.array_distinct(T.terms(F.coalesce(F.get("p", F.lit(1)), F.lit("")))).alias("consumed"))


def _asked(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def _shown(merged: DataFrame) -> DataFrame:
    return merged.select("query_id", "id", "rank", F.round("score", 9).alias("score"), "scale", F.round("ranking_score", 9).alias("ranking_score"), "ranking_scale")


def two_hop_expansion(spark, sf):
    """The fused list of dense and sparse search, and a second hop to what defines the symbols that its best rows use."""
    # K rows a query: read for its seeds, and again for the merged list.
    primary = R.cut(R.fuse_weighted({"dense": _dense(spark, sf, 40), "sparse": _sparse(spark, sf, 40)}), K).persist()
    return _shown(R.merge_hop(primary, R.second_hop(primary, _asked(spark, sf), _chunks(spark, sf)), K))


_FIRST = "split_part(text, chr(10), 1)"
_REST = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"


def _hop_sql(primary: str, scale: str, qualify: str = "") -> str:
    """CTEs from p(query_id, id, rank, score) to the merged list."""
    ordered = f"""uw AS (SELECT doc_id AS id, list_filter({Q.words(_REST)}, lambda w: length(w) BETWEEN 2 AND 128 AND lower(w) NOT IN ({Q.quoted(sorted({*T.STOP_WORDS, *T.DROPPED_WORDS}))})) AS ws FROM documents JOIN embeddings ON vec_id = doc_id),
ue AS (SELECT id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM uw), uses AS (SELECT id, {Q.stem(f"translate(lower(w), '{T.ACCENTS}', '{T.PLAIN}')")} AS term, min(pos) AS pos FROM ue GROUP BY ALL)"""
    return f"""{Q.terms('def', 'documents', 'doc_id', _FIRST)}, {ordered}, p AS ({primary}),
used AS (SELECT query_id, term, min(rank * 100000000 + pos) AS first FROM p JOIN uses USING (id) WHERE rank <= 5 AND trim(term) <> '' GROUP BY ALL),
few AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, term) AS n FROM used) WHERE n <= 50{qualify}),
cand AS (SELECT DISTINCT query_id, d.id FROM few JOIN def d USING (term) WHERE d.id <> query_id),
hs AS (SELECT query_id, id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS cosine FROM cand JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = id),
hop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS hop_rank FROM hs) WHERE hop_rank <= 20),
fused2 AS (SELECT query_id, id, p.rank, p.score, hop_rank, cosine, round(coalesce(1.0::DOUBLE / (10 + p.rank), 0) + coalesce(1.0::DOUBLE / (10 + hop_rank), 0), 12) AS s FROM p FULL JOIN hop USING (query_id, id)),
placed AS (SELECT *, count(rank) OVER (PARTITION BY query_id) AS size, count(hop_rank) OVER (PARTITION BY query_id) AS hops, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM fused2)
SELECT query_id, id, place AS rank, round(coalesce(score, cosine), 9) AS score, CASE WHEN rank IS NULL THEN 'SymbolExpansion' ELSE '{scale}' END AS scale, round(CASE WHEN hops > 0 THEN s ELSE score END, 9) AS ranking_score, CASE WHEN hops > 0 THEN 'SymbolExpansion' ELSE '{scale}' END AS ranking_scale FROM placed WHERE place <= size"""


_FUSED_10 = "SELECT query_id, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10"
TWO_HOP_EXPANSION = f"WITH {Q.dense(40)}, {Q.sparse(40)}, {_WEIGHTED}, {_hop_sql(_FUSED_10, 'RankFusionWeighted')}"


def two_hop_dense(spark, sf):
    """A dense list and its second hop, with a qualifier that lets pass symbols of eight letters or more; queries left without any abstain."""
    primary = _dense(spark, sf)
    keep = lambda w: w.select("query_id", F.filter("symbols", lambda s: F.length(s) >= 8).alias("symbols"))
    return _shown(R.merge_hop(primary, R.second_hop(primary, _asked(spark, sf), _chunks(spark, sf), keep), K, scale="Cosine"))


TWO_HOP_DENSE = f"WITH {Q.dense(K)}, {_hop_sql('SELECT query_id, id, rank, score FROM dense', 'Cosine', ' AND length(term) >= 8')}"


def _summaries(spark, sf) -> DataFrame:
    """(id, v): a summary vector for two of three vectors, the mean of its own and the next one's."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return e.where("id % 3 <> 0").join(after, "id").select("id", F.zip_with("v", "w", lambda x, y: (x + y) / 2).alias("v"))


def _three(spark, sf) -> dict[str, DataFrame]:
    q = _asked(spark, sf)
    return {"dense": _dense(spark, sf, 40), "sparse": _sparse(spark, sf, 40), "summary": R.dense_topk(q, _summaries(spark, sf), 40)}


def hybrid_three_branch(spark, sf):
    """Dense, sparse and summary ranks fused by their weights; vectors without a summary are absent from that branch."""
    return R.cut(R.fuse_weighted(_three(spark, sf)), K).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


_SUMMARY = """sv AS (SELECT a.vec_id AS id, list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) / 2) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 3 <> 0),
ss AS (SELECT q.vec_id AS query_id, id, round(list_dot_product(q.embedding::DOUBLE[], v), 9) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, sv WHERE id <> q.vec_id),
summary AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= 40)"""
HYBRID_THREE_BRANCH = f"""WITH {Q.dense(40)}, {Q.sparse(40)}, {_SUMMARY},
fused AS (SELECT query_id, id, round(sum(w / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank, 1.0::DOUBLE AS w FROM dense UNION ALL SELECT query_id, id, rank, 1.3::DOUBLE FROM sparse UNION ALL SELECT query_id, id, rank, 2.5::DOUBLE FROM summary) GROUP BY ALL)
{_CUT_K.format(k=K)}"""


def _hits(spark, sf, ranked=None):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    near = _dense(spark, sf) if ranked is None else ranked
    own, other = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), labels.select(F.col("vec_id").alias("id"), F.col("label").alias("dl"))
    return near.join(own, "query_id").join(other, "id", "left").select(F.col("query_id").alias("item"), F.concat(F.lit("c"), F.col("ql").cast("string")).alias("category"), "rank", (F.col("ql") == F.col("dl")).alias("is_target"))


def recall_at_k(spark, sf):
    return E.recall_at_k(_hits(spark, sf))


_RECALL = """t AS (SELECT query_id AS item, 'c' || q.label AS category, rank, q.label = d.label AS hit FROM {src} JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings d ON d.vec_id = id),
e AS (SELECT item, category, k, coalesce(max((rank <= k AND hit)::INT), 0) AS hit_k FROM t, (SELECT unnest([1, 3, 5, 10])::BIGINT AS k) GROUP BY ALL)"""
RECALL_AT_K = f"WITH {Q.dense(K)}, {_RECALL.format(src='dense')} SELECT coalesce(category, 'TOTAL') AS category, k, count(*) AS items, round(avg(hit_k), 6) AS any_rate FROM e GROUP BY GROUPING SETS ((category, k), (k))"


def weight_sweep(spark, sf):
    """Recall of lists fused from three branches over the grid of sparse and summary weights, best first: branches are ranked once, the grid is an array."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    swept = E.weight_sweep({name: b.select("query_id", "id", "rank") for name, b in _three(spark, sf).items()}, K)
    target = swept.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("dl")), "id", "left")
    each = target.groupBy("w_sparse", "w_summary", "query_id").agg(*(F.max(((F.col("rank") <= k) & F.coalesce(F.col("ql") == F.col("dl"), F.lit(False))).cast("int")).alias(f"k{k}") for k in (5, 10)))
    summed = each.groupBy("w_sparse", "w_summary").agg(F.count("*").alias("items"), F.round(F.avg("k5"), 6).alias("recall5"), F.round(F.avg("k10"), 6).alias("recall10"), F.sum("k10").cast("long").alias("solved"))
    return E.placed(summed, [F.desc("recall10"), F.desc("recall5"), F.asc("w_sparse"), F.asc("w_summary")])


WEIGHT_SWEEP = f"""WITH {Q.dense(40)}, {Q.sparse(40)}, {_SUMMARY}, g AS (SELECT a AS w_sparse, b AS w_summary FROM (SELECT unnest([1.0, 1.3, 1.6])::DOUBLE AS a), (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5])::DOUBLE AS b)),
f AS (SELECT w_sparse, w_summary, query_id, id, round(sum(c / (60 + rank)), 12) AS score FROM (SELECT g.*, query_id, id, rank, 1.0::DOUBLE AS c FROM dense, g UNION ALL SELECT g.*, query_id, id, rank, w_sparse FROM sparse, g UNION ALL SELECT g.*, query_id, id, rank, w_summary FROM summary, g) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY w_sparse, w_summary, query_id ORDER BY score DESC, id) AS rank FROM f),
h AS (SELECT w_sparse, w_summary, query_id, max((rank <= 5 AND coalesce(q.label = d.label, false))::INT) AS k5, max(coalesce(q.label = d.label, false)::INT) AS k10 FROM r JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings d ON d.vec_id = id WHERE rank <= 10 GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY recall10 DESC, recall5 DESC, w_sparse, w_summary) AS place FROM (SELECT w_sparse, w_summary, count(*) AS items, round(avg(k5), 6) AS recall5, round(avg(k10), 6) AS recall10, sum(k10)::BIGINT AS solved FROM h GROUP BY ALL)"""


def best_target_rank(spark, sf):
    """Of every query and configuration of branches the best rank of a target, and recall by cut-off."""
    three, labels = _three(spark, sf), table(spark, sf, "embeddings").select("vec_id", "label")
    arms = {"dense": ["dense"], "dense+sparse": ["dense", "sparse"], "dense+sparse+summary": ["dense", "sparse", "summary"]}
    own, other = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), labels.select(F.col("vec_id").alias("id"), F.col("label").alias("dl"))
    lists = {name: R.cut(R.fuse_weighted({b: three[b] for b in parts}), 40).join(own, "query_id").join(other, "id", "left").select(F.col("query_id").alias("item"), "rank", F.coalesce(F.col("ql") == F.col("dl"), F.lit(False)).alias("is_target")) for name, parts in arms.items()}
    return E.best_ranks(lists)


def _arm_sql(name: str, branches: dict[str, float]) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, rank, {w}::DOUBLE AS w FROM {b}" for b, w in branches.items())
    return f"""SELECT '{name}' AS arm, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(w / (60 + rank)), 12) AS score FROM ({parts}) GROUP BY ALL)"""


BEST_TARGET_RANK = f"""WITH {Q.dense(40)}, {Q.sparse(40)}, {_SUMMARY}, a AS ({_arm_sql('dense', {'dense': 1.0})} UNION ALL {_arm_sql('dense+sparse', {'dense': 1.0, 'sparse': 1.3})} UNION ALL {_arm_sql('dense+sparse+summary', {'dense': 1.0, 'sparse': 1.3, 'summary': 2.5})})
SELECT arm, query_id AS item, min(rank) FILTER (q.label = d.label) AS best_rank, coalesce(min(rank) FILTER (q.label = d.label) <= 5, false) AS hit5, coalesce(min(rank) FILTER (q.label = d.label) <= 10, false) AS hit10 FROM a JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings d ON d.vec_id = id WHERE rank <= 40 GROUP BY ALL"""


def _gate(spark, sf):
    """Labelled rows with a score between 0 and 1: the share of distinct terms among all terms, and whether the row is good."""
    d = documents(spark, sf).select("doc_id", T.terms(F.col("text")).alias("t"))
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.round(F.size(F.array_distinct("t")) / F.greatest(F.size("t"), F.lit(1)), 6).alias("score"), (F.col("quality") == 1).alias("present"))


_GATE = f"""{Q.terms('post', 'documents', 'doc_id', 'text')},
gate AS (SELECT doc_id, round(coalesce(a, 0) / greatest(coalesce(b, 0), 1), 6)::DOUBLE AS score, quality = 1 AS present FROM labels JOIN documents USING (doc_id) LEFT JOIN (SELECT id, count(*) AS a, sum(n) AS b FROM post GROUP BY id) ON id = doc_id)"""


def gate_bands(spark, sf):
    g = _gate(spark, sf).withColumn("band", E.band(F.col("score"), F.lit(1), 0.3, 0.6))
    return g.groupBy("band", "present").agg(F.count("*").alias("n"))


GATE_BANDS = f"WITH {_GATE} SELECT CASE WHEN score < 0.3 THEN 'none' WHEN score < 0.6 THEN 'mid' ELSE 'high' END AS band, present, count(*) AS n FROM gate GROUP BY ALL"

LOWS, HIGHS = [round(0.1 + 0.05 * i, 2) for i in range(11)], [round(0.3 + 0.05 * i, 2) for i in range(12)]


def gate_threshold_sweep(spark, sf):
    return E.threshold_sweep(_gate(spark, sf), LOWS, HIGHS)


GATE_THRESHOLD_SWEEP = f"""WITH {_GATE}, g AS (SELECT low, high FROM (SELECT unnest({LOWS})::DOUBLE AS low), (SELECT unnest({HIGHS})::DOUBLE AS high) WHERE low < high)
SELECT low, high, count(*) FILTER (score >= low) AS delivered, count(*) FILTER (score >= high AND NOT present) AS fabrications, count(*) FILTER (score >= low AND score < high AND present) AS hedged_present,
 count(*) FILTER (score >= low AND score < high AND NOT present) AS hedged_absent, count(*) FILTER (score < low AND present) AS lost, count(*) FILTER (score < low AND NOT present) AS rejected FROM gate, g GROUP BY ALL"""


def auc_ties(spark, sf):
    return E.auc(_gate(spark, sf))


AUC_TIES = f"""WITH {_GATE} SELECT (SELECT count(*) FROM gate WHERE present) AS positives, (SELECT count(*) FROM gate WHERE NOT present) AS negatives,
 round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9)::DOUBLE AS auc FROM (SELECT score FROM gate WHERE present) p, (SELECT score FROM gate WHERE NOT present) n"""


def class_overlap(spark, sf):
    return E.class_overlap(_gate(spark, sf))


CLASS_OVERLAP = f"""WITH {_GATE}, s AS (SELECT min(score) FILTER (present) AS a, max(score) FILTER (NOT present) AS b FROM gate)
SELECT present, count(*) AS n, round(min(score), 6) AS low, round(quantile_cont(score, 0.5), 6) AS mid, round(max(score), 6) AS high, count(*) FILTER (score BETWEEN a AND b) AS inside FROM gate, s GROUP BY present"""


def relative_cut(spark, sf):
    return E.relative_cut(_dense(spark, sf), 0.9).select("query_id", "id", "rank")


RELATIVE_CUT = f"WITH {Q.dense(K)} SELECT query_id, id, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM dense) WHERE score >= 0.9::DOUBLE * best"


def gap_cut(spark, sf):
    return E.gap_cut(_dense(spark, sf), 0.05).select("query_id", "id", "rank")


GAP_CUT = f"""WITH {Q.dense(K)}, m AS (SELECT *, max(score) OVER w - score > 0.05::DOUBLE AS gone FROM dense WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, id, rank FROM m WHERE rank < coalesce((SELECT min(rank) FROM m x WHERE x.query_id = m.query_id AND gone), 1000)"""

QUERIES = {
    "content_identity": (content_identity, CONTENT_IDENTITY),
    "token_estimate_stats": (token_estimate_stats, TOKEN_ESTIMATE_STATS),
    "truncated_texts": (truncated_texts, TRUNCATED_TEXTS),
    "sparse_terms": (sparse_terms, SPARSE_TERMS),
    "sparse_vector_hashed": (sparse_vector_hashed, SPARSE_VECTOR_HASHED),
    "sparse_topk": (sparse_topk, SPARSE_TOPK),
    "dense_topk": (dense_topk, DENSE_TOPK),
    "dense_topk_min_score": (dense_topk_min_score, DENSE_TOPK_MIN_SCORE),
    "dense_topk_filtered": (dense_topk_filtered, DENSE_TOPK_FILTERED),
    "rrf_native": (rrf_native, RRF_NATIVE),
    "rrf_weighted": (rrf_weighted, RRF_WEIGHTED),
    "hybrid_search": (hybrid_search, HYBRID_SEARCH),
    "pool_sizes": (pool_sizes, POOL_SIZES),
    "two_hop_expansion": (two_hop_expansion, TWO_HOP_EXPANSION),
    "two_hop_dense": (two_hop_dense, TWO_HOP_DENSE),
    "hybrid_three_branch": (hybrid_three_branch, HYBRID_THREE_BRANCH),
    "best_target_rank": (best_target_rank, BEST_TARGET_RANK),
    "recall_at_k": (recall_at_k, RECALL_AT_K),
    "weight_sweep": (weight_sweep, WEIGHT_SWEEP),
    "gate_bands": (gate_bands, GATE_BANDS),
    "gate_threshold_sweep": (gate_threshold_sweep, GATE_THRESHOLD_SWEEP),
    "auc_ties": (auc_ties, AUC_TIES),
    "class_overlap": (class_overlap, CLASS_OVERLAP),
    "relative_cut": (relative_cut, RELATIVE_CUT),
    "gap_cut": (gap_cut, GAP_CUT),
}
