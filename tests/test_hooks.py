"""Extension points and stores that no registered query reaches."""

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import context as X
from cairn.operators import evaluation as E
from cairn.operators import retrieval as R
from cairn.operators import summaries
from cairn.operators import store as S
from cairn.operators.chunking import assemble, route
from cairn.sources.collections import Collections
from cairn.streaming import limits


def test_rerank_keeps_the_winner_in_place(spark):
    pool = spark.createDataFrame([(1, "q", 7, "bb"), (1, "q", 3, "a"), (1, "q", 5, "a"), (2, "q", 1, "c")], "query_id long, query string, id long, content string")
    got = R.rerank(pool, lambda pairs: [len(c) for _, c in pairs]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 7), (1, 3), (1, 5), (2, 1)]
    stable = R.rerank(pool, lambda pairs: [len(c) if len(pairs) > 1 else -9 for _, c in pairs], stable=True).where("query_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in stable] == [7, 3, 5]


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "i int, t string")
    got = {r["id"]: r["v"] for r in V.embed(rows, "i", "t", V.hashing_encoder(16), 16).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[3])


def test_summaries(spark):
    chunks = spark.createDataFrame([("p", None, "h1", 1, "one"), ("p", None, "h2", 9, "two"), ("q", "C", "h3", 1, "bad"), ("r", "C", "h4", 1, "none")], "path string, class_name string, content_hash string, start_line int, content string")
    wanted = summaries.groups(chunks, per_file=True)
    assert sorted(r["content"] for r in wanted.collect()) == ["bad", "none", "one\ntwo"]

    def generate(text):
        if text == "bad":
            raise ValueError(text)
        return None if text == "none" else text.upper()

    empty = spark.createDataFrame([], "group_key string, version string")
    made = summaries.summarise(wanted, empty, "v1", generate)
    assert sorted((r["summary"], r["negative"]) for r in made.collect() if r["summary"]) == [("ONE\nTWO", False)]
    assert made.where("negative").count() == 1
    assert summaries.summarise(wanted, made, "v1", generate).count() == 0
    assert summaries.summarise(wanted.coalesce(1), empty, "v1", lambda t: 1 / 0, breaker=2).count() == 0


def test_collections(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "c"))
    assert store.names() == []
    points = spark.createDataFrame([(1, True), (2, False)], "id long, summary_pending boolean")
    manifest = spark.createDataFrame([("a", "h", 64, None, ["s"], None)], "collection string, model_hash string, dimension int, profile string, required_scopes array<string>, tenants array<string>")
    store.ensure("a", points, manifest)
    store.ensure("a", points, manifest)
    assert store.names() == ["a"] and store.exists("a") and not store.exists("b") and store.points("a").count() == 0
    store.replace("a", S.merge_points(store.points("a"), points, "id"))
    store.replace("a", S.merge_points(store.points("a"), points.where("id = 2").withColumn("summary_pending", F.lit(True)), "id"))
    assert store.pending("a") == 2 and store.manifests().first()["dimension"] == 64
    store.recreate("a", points, manifest)
    assert store.points("a").count() == 0


def test_routing_and_assembly(spark):
    files = spark.createDataFrame([(1, "Markdown", "# T\npara"), (2, "TypeScript", "function f(a) {\n}\n"), (3, "Sql", "select 1"), (4, None, "text")], "id int, language string, text string")
    got = {(r["id"], r["kind"]) for r in route(files).collect()}
    assert got == {(1, "MarkdownSection"), (2, "Function"), (3, "PlainTextWindow"), (4, "PlainTextWindow")}
    made = assemble(route(files), F.lit("repo"), F.col("id").cast("string"))
    assert made.select("chunk_id").distinct().count() == 4
    assert all(len(r["chunk_id"]) == 36 and r["token_count"] >= 1 for r in made.collect())


def test_cuts(spark):
    ranked = spark.createDataFrame([(1, i, r, s) for i, (r, s) in enumerate([(1, 0.9), (2, 0.88), (3, 0.5), (4, 0.49)])], "query_id int, id int, rank int, score double")
    assert [r["rank"] for r in E.relative_cut(ranked, 0.95).collect()] == [1, 2]
    assert [r["rank"] for r in E.gap_cut(ranked, 0.1).collect()] == [1, 2]
    stable = spark.createDataFrame([(1, 0.1)], "query_id int, score double")
    assert [r["score"] for r in E.winner_substituted(ranked, stable).orderBy("rank").collect()] == [0.1, 0.88, 0.5, 0.49]


def test_banker_p95(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(11)] + [("b", 99, 5.0)], "k string, i int, v double")
    whole = {r["k"]: r["p"] for r in rows.groupBy("k").agg(E.banker_p95(F.collect_list("v")).alias("p")).collect()}
    ranked = {r["k"]: r["p95_banker"] for r in E.banker_rank(rows, "k", "v", "i").collect()}
    assert whole == ranked == {"a": 10.0, "b": 5.0}


def test_events_and_texts(spark):
    assert [k for _, k, _ in X.ask_events("q", "high", 3, ["a", "b"], "no")] == ["ContextReady", "Fragment", "Fragment", "Completed"]
    assert X.ask_events("q", "none", 3, [" no "], "no")[0][2] == "0" and X.ask_events("q", "none", 3, [" no "], "no")[-1][2] == "declined"
    one = spark.createDataFrame([("a b  c", "b c"), ("abab", "ab"), ("abc", "x")], "h string, n string")
    assert [r[0] for r in one.select(T.locate_once(F.col("h"), F.col("n"))).collect()] == [1, None, None]


def test_rate_limit_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "actor string, ts timestamp"
    rows = [("u", i) for i in range(5)] + [("u", 7200)]
    spark.createDataFrame(rows, "actor string, s int").select("actor", F.timestamp_seconds("s").alias("ts")).write.parquet(source)
    stream = limits.fixed_window_stream(spark.readStream.schema(schema).parquet(source), "actor", "ts", 60, 3)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    assert [(r["asked"], r["rejected"]) for r in spark.table("limited").collect()] == [(5, 2)]
