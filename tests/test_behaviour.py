"""Behaviour that the contract fixes by example: fusion, stemming, ignore rules, percentiles, bounds, budgets, chunk lines, streams."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
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
from cairn.streaming import ingest, limits


def column(spark, values, expr, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_uuid5_equals_the_library(spark):
    names = ["a", "repo/x.cs:1:ff", "é", ""]
    assert column(spark, names, I.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_stems_meet(spark):
    words = ["auditoria", "auditorias", "regla", "reglas", "rule", "rules", "class", "process", "código", "codigo", "data"]
    got = column(spark, words, lambda w: T.stem(T.fold(w)))
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and got[8] == got[9]
    assert got[6:8] == ["class", "process"] and got[10] == "data"


def test_lexer(spark):
    text = "GetOrder HTTPSClient // hidden\n/* also\nhidden */ \"quoted word\" 'x' 12ab_c.d der_Weg the"
    assert column(spark, [text, None, ""], T.words) == [["Get", "Order", "HTTPS", "Client", "der", "Weg", "the"], None, []]
    assert column(spark, ["the public x orders a"], T.terms) == [["order"]]


def python_murmur(t):
    mask = 0xFFFFFFFF
    rot = lambda a, r: (a << r | a >> 32 - r) & mask
    mix = lambda k: rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h, u = 0xDEADC0DE, [ord(c) for c in t]
    for a, b in zip(u[::2], u[1::2]):
        h = (rot(h ^ mix((a | b << 16) & mask), 13) * 5 + 0xE6546B64) & mask
    if len(u) % 2:
        h ^= mix(u[-1])
    h ^= len(u)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0xD7FF), max_size=12), min_size=1, max_size=30))
def test_murmur(spark, words):
    assert column(spark, words, T.murmur3) == [python_murmur(w) for w in words]


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank long")


def test_fusion(spark):
    a, b = ranks(spark, [(1, 10, 1), (1, 11, 2)]), ranks(spark, [(1, 11, 1), (1, 12, 2)])
    got = {r["id"]: (r["rank"], r["score"]) for r in R.cut(R.fuse_weighted({"dense": a, "sparse": b}, {"dense": 1, "sparse": 1}), 9).collect()}
    assert got[11][0] == 1 and got[11][1] == pytest.approx(1 / 61 + 1 / 62)
    # An exact tie goes to the smaller id; a weight of zero leaves the candidate without score.
    tie = R.cut(R.fuse_weighted({"dense": ranks(spark, [(1, 7, 1)]), "sparse": ranks(spark, [(1, 3, 1)])}, {"dense": 1, "sparse": 1}), 9)
    assert [r["id"] for r in tie.orderBy("rank").collect()] == [3, 7]
    zero = R.fuse_weighted({"dense": a, "sparse": b}, {"dense": 0, "sparse": 1}).where("id = 10").collect()
    assert zero[0]["score"] == 0
    native = {r["id"]: r["score"] for r in R.fuse_native([a, b]).collect()}
    assert native[11] == pytest.approx(1 / 3 + 1 / 2)


def test_hop_displaces(spark):
    """The hop decides places; a primary row keeps its score and scale, a new one bears its cosine."""
    primary = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.7), (2, 5, 1, 0.4)], "query_id long, id long, rank long, score double")
    hop = spark.createDataFrame([(1, 9, 1, 0.55), (1, 2, 2, 0.5)], "query_id long, id long, rank long, score double")
    got = [tuple(r) for r in R.merge_hop(primary, hop, 3).orderBy("query_id", "rank").select("query_id", "id", "rank", "score", "scale", "ranking_scale").collect()]
    fused, hopped = "RankFusionWeighted", "SymbolExpansion"
    assert got == [(1, 2, 1, 0.8, fused, hopped), (1, 1, 2, 0.9, fused, hopped), (1, 9, 3, 0.55, hopped, hopped), (2, 5, 1, 0.4, fused, fused)]


def test_hop_asks_for_symbols_in_order_and_may_abstain(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], ["a"], ["x", " ", "y"]), (2, [0.9, 0.1], ["x"], ["z"]), (3, [0.2, 0.9], ["y"], []), (4, [0.0, 1.0], ["z"], []), (7, [0.5, 0.5], ["q"], [])], "id long, v array<double>, defined array<string>, consumed array<string>")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, v array<double>")
    primary = spark.createDataFrame([(100, 1, 1), (100, 2, 2)], "query_id long, id long, rank long")
    asked = {r["query_id"]: r["symbols"] for r in R.harvest(primary, chunks.select("id", F.col("consumed").alias("symbols")), max_symbols=2).collect()}
    assert asked == {100: ["x", "y"]}
    hop = [(r["id"], r["rank"]) for r in R.second_hop(primary, queries, chunks).orderBy("rank").collect()]
    assert hop == [(2, 1), (3, 2), (4, 3)]
    none = R.second_hop(primary, queries, chunks, lambda w: w.withColumn("symbols", F.array().cast("array<string>")))
    assert none.collect() == []


def test_blocked_scores_equal_broadcast_ones(spark, monkeypatch):
    import random

    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], i % 3, [f"s{i % 5}"]) for i in range(90)], "id long, v array<double>, label int, defined array<string>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), "v", "label", F.array(F.lit("s1"), F.lit("s3")).alias("wanted"))
    take = lambda: sorted(map(tuple, R.dense_topk(q, v, 4, same="label", any_of=("wanted", "defined")).collect()))
    whole = take()
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert take() == whole and whole


def test_sparse_index_equals_join(spark):
    d = spark.createDataFrame([(i, " ".join(["alpha beta gamma", "delta alpha", "list task", "omega beta beta"][j] for j in range(4) if i >> j & 1)) for i in range(16)], "doc_id long, text string")
    q = R.postings(d.where("doc_id % 3 = 0"), "doc_id", "text")
    for itself in (False, True):
        a, b = (sorted(map(tuple, R.sparse_topk(q, d, 5, "doc_id", "text", itself=itself, limit=n).collect())) for n in (0, 10**6))
        assert a == b and a


def test_decorators_and_packing(spark):
    from cairn.operators import chunking as C

    code = "@Injectable()\n@Component({ a: 1 })\nexport class Foo {\n  run(a: string): void {\n    go('}');\n  }\n}\nlet x = 1\n"
    assert C.brace_blocks(code) == [(1, 2, "PlainTextWindow", None, None), (3, 7, "Class", "Foo", "Component"), (8, 9, "PlainTextWindow", None, None)]
    long = "function big(a) {\n" + "\n\n".join("  const v%d = '%s';" % (i, "z" * 300) for i in range(20)) + "\n}"
    rows = C.brace_chunks(spark.createDataFrame([(1, long)], "id long, text string")).orderBy("start_line").collect()
    assert len(rows) > 1 and {r["name"] for r in rows} == {"big"}
    assert all((len(r["content"]) + 3 + 3) // 4 <= C.MAX_TOKENS for r in rows)
    assert "".join(r["content"] for r in rows).replace("\n", "") == long.replace("\n", "")
    lines = long.split("\n")
    assert all(r["content"] == "\n".join(lines[r["start_line"] - 1 : r["end_line"]]) for r in rows)
    defined, consumed = C.symbol_roles(F.col("t"))
    got = spark.createDataFrame([("class A { void Run(int a) { Other.Go(a); } }",)], "t string").select(defined.alias("d"), consumed.alias("c")).first()
    assert got["d"] == ["A", "Run"] and got["c"] == ["Go", "Other", "a"]


def test_sanitizer_golden(spark):
    """What the sanitizer must give for given answers."""
    cases = {"Usa `GenerarPlan` ya": "Usa generar plan ya", "x ```cs\nvar a;\n``` y": "x (code) y", "x ```\n``` y": "x  y", "`a + b`": "(id)", "[Attr(1)] z": "(id) z", "Foo.BarBaz y snake_case_id": "foo bar baz y snake case id", "AbcDef": "abc def", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", T.sanitize(F.col("a"), F.lit("(code)"), F.lit("(id)")).alias("s")).collect()
    assert {r["a"]: r["s"] for r in got} == cases


def test_failed_files_are_counted(spark, tmp_path):
    from cairn.sources import files as L

    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.cs").write_text("class A {}")
    (tmp_path / "repo" / "b.cs").write_bytes(b"\xff\xfe\x00bad")
    found = L.scan(spark, str(tmp_path / "repo"))
    assert {r["relative_path"]: (r["text"], r["failed"]) for r in found.collect()} == {"a.cs": ("class A {}", None), "b.cs": (None, "not UTF-8")}
    assert {r["state"]: r["files"] for r in L.scan_summary(found).collect()} == {"Processed": 1, "Failed": 1}


def test_gzipped_json_set(spark, tmp_path):
    import gzip

    from cairn.sources import files as L

    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        f.write('[{"a": 1, "b": ["x"]}, {"a": 2}]')
    assert [(r["a"], r["b"]) for r in L.json_set(spark, str(tmp_path / "s.json.gz"), "a long, b array<string>").orderBy("a").collect()] == [(1, ["x"]), (2, None)]


def test_ties_do_not_follow_partitions(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id long, v array<double>")
    q = v.where("id = 5").withColumnRenamed("id", "query_id")
    for frame in (v, v.repartition(7), v.orderBy(F.desc("id"))):
        assert [r["id"] for r in R.dense_topk(q, frame, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_module_boundary(spark):
    frame = spark.createDataFrame([("a.b", "a"), ("ab", "a"), ("a", "a"), ("a", " "), (None, "a")], "v string, m string")
    assert [r[0] for r in frame.select(R.module_boundary(F.col("v"), F.col("m"), ".")).collect()] == [True, False, True, False, None]
    rows = spark.createDataFrame([(1, "t"), (2, None)], "id int, tenant string")
    assert [r["id"] for r in R.metadata_filter(rows, tenant="t").collect()] == [1]


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        (["*.tmp"], "a/b.tmp", True),
        (["logs/"], "logs/a/b.json", True),
        (["logs/"], "logs", False),
        (["docs/eval"], "docs/eval/x", True),
        (["docs/eval"], "x/docs/eval", False),
        (["*.cs", "!Keep.cs"], "src/Keep.cs", False),
        (["!Keep.cs", "*.cs"], "src/Keep.cs", True),
        (["**/gen/*.ts"], "a/b/gen/x.ts", True),
        (["a?c"], "abc", True),
        (["a?c"], "a/c", False),
        (["# no", ""], "no", False),
        (["/top"], "sub/top", False),
        ([".env"], ".env", False),
    ],
)
def test_ignore_rules(spark, rules, path, want):
    assert column(spark, [path], lambda p: L.ignored(p, L.parse_rules(rules))) == [want]


@pytest.mark.parametrize(("values", "want"), [([], None), ([5], 5), ([1, 2, 3], 3), (list(range(1, 21)), 19)])
def test_nearest_rank(spark, values, want):
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    assert frame.agg(E.nearest_rank("v", 0.95)).first()[0] == want


def test_gate(spark):
    rows = spark.createDataFrame([(0.05, 1, "Cosine"), (0.04, 1, "Cosine"), (0.6, 1, "Cosine"), (0.9, 0, "Cosine"), (0.0, 3, "Rrf")], "s double, n int, scale string")
    assert [r[0] for r in rows.select(X.assess(F.col("s"), F.col("n"), F.col("scale"), 0.05, 0.6)).collect()] == ["mid", "none", "high", "none", "high"]


def test_auc_ties(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "score double, present boolean")
    assert E.auc(rows).first()["auc"] == 0.875


def test_verdicts(spark):
    def verdict(pairs):
        a, b = (spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "q int, hit boolean") for k in (0, 1))
        return E.regression_verdict(E.compare_arms(a, b, "q", "hit")).first()["verdict"]

    assert verdict([(True, False), (True, True)]) == "pass"
    assert verdict([(True, False), (True, False)]) == "regression"
    a = spark.createDataFrame([(1, True)], "q int, hit boolean")
    assert E.regression_verdict(E.compare_arms(a, a.where("q > 1"), "q", "hit")).first()["verdict"] == "incomparable"


def test_budgets(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 9, 1])], "k string, i int, n int")
    assert [r["i"] for r in X.budget_stop(rows, "k", ["i"], "n", 10).collect()] == [0]
    assert column(spark, [[5, 90, 1]], lambda x: X.budget_skip(x, 30, 7), "array<int>") == [[True, False, True]]
    assert column(spark, [[2000, 40, 40, 5000, 1]], lambda x: C.budget_groups(x, F.lit(10)), "array<int>") == [[0, 1, 1, 2, 3]]


def test_markdown_lines(spark):
    text = "intro\n\n# One\npara a\npara a2\n\npara b\n## Two\nx"
    got = C.markdown_chunks(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("section").collect()
    assert [(r["header"], r["start_line"], r["end_line"]) for r in got] == [("Documento Principal", 1, 2), ("One", 3, 7), ("Two", 8, 9)]
    assert got[1]["content"] == "[Sección: One]\n\npara a\npara a2\n\npara b"


def test_windows(spark):
    text = "\n".join(f"line {i}" for i in range(60))
    for body in (text, text.replace("\n", "\r\n")):
        got = C.window_chunks(spark.createDataFrame([(1, body)], "id int, text string")).orderBy("fragment").collect()
        assert [(r["start_line"], r["end_line"]) for r in got] == [(1, 25), (23, 47), (45, 60)]
    assert C.window_chunks(spark.createDataFrame([(1, None), (2, " \n ")], "id int, text string")).count() == 0


def test_brace_blocks():
    code = "import x\n\nexport class A {\n  f() { return '}'; } // }\n}\nfunction g(a) {\n/* } */\n}\nconst h = (x) => {\n}\ntail\nfunction open() {\n"
    got = C.brace_blocks(code)
    assert [x[:4] for x in got] == [(1, 2, "PlainTextWindow", None), (3, 5, "Class", "A"), (6, 8, "Function", "g"), (9, 10, "Function", "h"), (11, 11, "PlainTextWindow", None), (12, 13, "Function", "open")]


def test_sanitizer(spark):
    answer = "Use `GenerarPlan` or `a + b`; TipoEstatus.Completado, some_snake_name, ServicioCliente [Attr(1)]\n```c\nx\n``` ```\n``` Auditoria"
    want = "Use generar plan or (id); tipo estatus completado, some snake name, servicio cliente (id)\n(code)  Auditoria"
    assert column(spark, [answer], lambda a: T.sanitize(a, "(code)", "(id)")) == [want]


def test_access(spark):
    ok = lambda *v: spark.range(1).select(A.may_read(*(F.lit(x).cast("string") if isinstance(x, str | None) else F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<string>") for x in v))).first()[0]
    assert ok(True, False, [], [], None, ["x"])
    assert ok(False, True, ["s"], ["s", "t"], "x", ["x"]) and ok(False, True, ["s"], ["s"], None, [])
    assert not ok(False, True, ["s"], ["s"], None, ["x"]) and not ok(False, False, ["s"], ["s"], "x", []) and not ok(False, True, ["u"], ["s"], "x", [])


def test_store(spark):
    new = spark.createDataFrame([(1, 5, "b"), (1, 9, "c"), (2, 1, "d")], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in S.upsert_latest(new, "k", "t", "v").collect()} == {1: "c", 2: "d"}
    old = spark.createDataFrame([(2, 0, "x"), (3, 0, "y")], "k int, t int, v string")
    once = S.merge_points(old, S.upsert_latest(new, "k", "t", "v"), "k")
    twice = S.merge_points(once, S.upsert_latest(new, "k", "t", "v"), "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 3
    states = S.latest_state(spark.createDataFrame([(1, 1, "Start"), (1, 3, "Done"), (1, 2, "Run")], "d int, at int, s string"), "d", "at", "s", "s").first()
    assert (states["state"], states["started_at"], states["updated_at"]) == ("Done", 1, 3)
    with pytest.raises(Exception, match="model mismatch"):
        spark.range(1).select(S.require_model(F.lit("a"), F.lit("b"))).collect()


def test_walk_keeps_to_allowed(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (2, 1), (4, 4)], "src long, dst long")
    allowed = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    got = {(r["node"], r["hop"]) for r in N.walk(edges, spark.createDataFrame([(1,)], "node long"), allowed, 3).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_scan(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"src/A.cs": "class A {}", "src/b.ts": "x", "bin/c.cs": "no", "docs/d.md": "# T", "e.exe": "no", "logs/f.txt": "no", "src/Big.txt": "z" * 600_000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    got = {r["relative_path"]: r["language"] for r in L.scan(spark, str(root), ["logs/"]).collect()}
    assert got == {"src/A.cs": "CSharp", "src/b.ts": "TypeScript", "docs/d.md": "Markdown"}


def test_stream_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "id long, source string, text string"
    text = "\n".join(f"line {i}" for i in range(30))
    spark.createDataFrame([(1, "a", text), (2, "b", "short text")], schema).write.parquet(source)
    ingest.ingest(spark, source, schema, target, checkpoint).awaitTermination()
    first = ingest.read_latest(spark, target).count()
    spark.createDataFrame([(3, "c", text), (1, "a", text)], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, target, checkpoint).awaitTermination()
    assert first == 3 and ingest.read_latest(spark, target).count() == 5


def test_limits(spark):
    rows = [("u", i, i) for i in range(4)]
    events = spark.createDataFrame(rows, "actor string, s int, n int").withColumn("ts", F.timestamp_seconds("s"))
    assert limits.fixed_window(events, "actor", "ts", "n", 60, 3).where("rejected").count() == 1
    spans = spark.createDataFrame([("u", 0, 10), ("u", 1, 9), ("u", 2, 3), ("u", 10, 12)], "actor string, start int, end int")
    got = {r["at"]: (r["running"], r["over"]) for r in limits.concurrency(spans, "actor", 2).collect()}
    assert got[2] == (3, True) and got[10] == (1, False)


def test_llm_stays_apart():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "cairn"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "cairn.llm" not in p.read_text() and "from .llm" not in p.read_text()


def test_lexer_holds_long_quotes_and_parts_words(spark):
    """A quote of 200,000 characters overflowed the stack of the lexer; its parts and stems stay as they were."""
    texts = ["a word '" + "b c " * 50_000, "a \"" + "\\\" x" * 50_000 + "\" after", "HTTPServer getX aBCd classes tablas clases sas İs ΑΣ 12ab x1Y2 don't \"quoted\" /* c */ rest // end"]
    assert column(spark, texts, T.terms) == [["word"], ["after"], ["http", "server", "cd", "class", "tabl", "clas", "sas", "i̇s", "ας", "x1y2", "don"]]


def test_terms_are_hashed_alike(spark):
    words = ["", "a", "ab", "abc", "niño", "größe", "日本語", "x" * 128]
    assert [T.bucket_of(w) for w in words] == column(spark, words, T.bucket)
    rows = spark.createDataFrame([(i, w, 0.5) for i, w in enumerate(words)], "id long, term string, weight double")
    assert sorted((r["id"], r["term_index"]) for r in T.with_bucket(rows, 2).collect()) == [(i, T.bucket_of(w)) for i, w in enumerate(words)]


def test_scores_are_computed_once(spark):
    """AUC and overlap read their scores from one pass, and give what pairs of rows give."""
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.5, False), (0.7, True), (0.4, True)]
    calls = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    frame = lambda: spark.createDataFrame(rows, "score double, present boolean").mapInArrow(run, "score double, present boolean")
    assert E.auc(frame()).first().auc == round((1.5 + 1.5 + 3) / 9, 9) and calls.value == len(rows)
    got = {r.present: (r.n, r.low, r.mid, r.high, r.inside) for r in E.class_overlap(frame()).collect()}
    assert got == {True: (3, 0.4, 0.4, 0.7, 2), False: (3, 0.1, 0.4, 0.5, 2)} and calls.value == 2 * len(rows)


def test_windows_count_whole_seconds(spark):
    """As the SQL rounds: half a second before the hour is the next hour's window, no time is a window too, and windows meet at zero from both sides."""
    rows = [(i, "a", t) for i, t in enumerate(["2024-01-01 00:59:59.4", "2024-01-01 00:59:59.6", "2024-01-01 01:00:01", "1970-01-01 00:10:00", "1969-12-31 23:50:00", None, None])]
    events = spark.createDataFrame(rows, "n long, actor string, t string")
    for kind in ("timestamp_ntz", "timestamp"):
        got = limits.fixed_window(events.withColumn("ts", F.col("t").cast(kind)), "actor", "ts", "n", 3600, 1).where("rejected")
        assert sorted(r["n"] for r in got.collect()) == [2, 3, 6]


def test_taken_within_is_the_fold(spark):
    sizes = [None, 0, 5, 90, 0, 1, 24, 3, 2, 30, 0, None, 4]
    rows = [(g, i, n) for g in ("a", "b", None) for i, n in enumerate(sizes if g != "b" else sizes[::-1])]
    frame = spark.createDataFrame(rows, "g string, i long, n int")
    got = sorted(((r["g"] or "", r["i"]) for r in X.taken_within(frame, "g", "i", "n", 40, 7).collect()))
    want = [(g or "", i) for g in ("a", "b", None) for i, ok in enumerate(column(spark, [[r[2] for r in rows if r[0] == g]], lambda x: X.budget_skip(x, 40, 7), "array<int>")[0]) if ok]
    assert got == sorted(want) and "collect_list" not in X.taken_within(frame, "g", "i", "n")._jdf.queryExecution().toString()


def test_brace_chunks_come_by_small_batches(spark):
    """Texts of 20 MB in one part reach the scanner, and leave it, by about two MB."""
    text = "function f(a) {\n" + "x" * 40_000 + "\n}"
    files = spark.range(500).select("id", F.lit(text).alias("text")).coalesce(1)

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    seen = C.brace_chunks(files).select("id", "content").mapInArrow(count, "n long").collect()
    assert sum(r[0] for r in seen) == 500 and max(r[0] for r in seen) <= 256


def test_qualified_hop_keeps_pairs_apart(spark):
    """A pair that several methods join comes once, without telling pairs apart afterwards."""
    chunks = spark.createDataFrame([(1, "a", ["m", "n", "o"]), (2, "a", ["n", "o", "n"]), (2, "a", ["p"]), (3, "b", ["m"]), (4, None, ["m"]), (5, "a", [None, "x"])], "id long, class_name string, defined array<string>")
    targets = spark.createDataFrame([(9, "a", m) for m in ("o", "n", "p", "z", None)] + [(8, None, "m"), (8, "b", "m"), (9, "a", "n")], "query_id long, class_name string, method string")
    hop = R.qualified_hop(chunks, targets)
    assert sorted((r["query_id"], r["id"]) for r in hop.collect()) == [(8, 3), (9, 1), (9, 2)]
    assert "Distinct" not in (plan := hop._jdf.queryExecution().toString()) and "Deduplicate" not in plan


def test_symbol_pairs_are_counted_not_formed(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice("xy"), f"s{rng.randrange(60)}", rng.choice(["defined", "consumed"])) for _ in range(400)]
    symbols = spark.createDataFrame(rows, "id long, tenant string, symbol string, kind string")
    want = {(t, a, b) for a, t, s, k in rows if k == "consumed" for b, u, z, m in rows if m == "defined" and (t, s) == (u, z) and a != b}
    joined = N.symbol_join(symbols)
    assert {r["tenant"]: r["pairs"] for r in joined.collect()} == {t: sum(x[0] == t for x in want) for t in "xy"}
    assert "src" not in joined._jdf.queryExecution().toString()


def test_sparse_search_forms_no_pairs(spark):
    """More postings than a block holds: blocks of queries, the k best of each task, no join by term."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.choice('abcdefgh')}x{rng.randrange(9)}" for _ in range(rng.randrange(12)))) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = R.postings(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    few, many = (R.sparse_topk(asked, docs, 4, "doc_id", "text", limit=n) for n in (50, 10**6))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and "Join" not in few._jdf.queryExecution().toString()


def test_walk_asks_for_the_frontier_alone(spark):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 40) for i in range(40) for j in range(2)], "src long, dst long")
    seeds, allowed = spark.createDataFrame([(0,), (3,)], "node long"), spark.createDataFrame([(i,) for i in range(40) if i % 5], "node long").union(spark.createDataFrame([(0,)], "node long"))
    asked = []

    def some(nodes):
        asked.append({r["node"] for r in nodes.collect()})
        return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")

    assert sorted(map(tuple, N.walk(some, seeds, allowed, 2).collect())) == sorted(map(tuple, N.walk(edges, seeds, allowed, 2).collect()))
    assert asked[0] == {0, 3} and all(len(a) < 40 for a in asked)
