"""Secrets, SimHash and quality rules against plain Python versions."""

import hashlib
import re

import pytest
import xxhash

from cairn.llm import queries
from cairn.llm.quality_rules import binomial_tail
from cairn.llm.secrets import scan

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def spans(t):
    kinds = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= n)


def test_secrets(spark, corpus):
    body, folder = corpus
    want = []
    for i, t in body:
        s = spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want.append((i, *(sum(k == x[2] for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()))
    got = rows(spark, folder, "op4_secret_scans")
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert any("pem:" in r["spans"] for r in got)


def test_ledger_is_incremental(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "nothing"), (3, "token=abcdefgh1")], "doc_id long, text string")
    paths, ledger = scan(first)
    assert ledger.count() == 1 and sorted(r["doc_id"] for r in paths.collect() if r["spans"]) == [1, 3]
    again = first.unionByName(spark.createDataFrame([(4, "secret: zzzzzzzz9"), (5, "token=abcdefgh1")], first.schema))
    paths, added = scan(again, ledger)
    assert added.count() == 1
    assert {r["doc_id"]: len(r["spans"] or []) for r in paths.collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_private_keys_are_masked_whole(spark):
    from cairn.llm.secrets import redact

    body = "\n".join(["MIIEpAIBAAKCAQEA7bq1" * 3] * 4)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {begin}\n{body}\n{end} z"), (2, f"a {begin}\n{body}\n\nplain words follow"), (3, f"x {begin}\nProc-Type: 4,ENCRYPTED\n\n{body}\n{end}\n{begin}\n{body}\n{end}"), (4, f"only {begin} here")]
    docs = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id long, text string, gated boolean, blob string")
    got = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert got == {1: "a [secret] z", 2: "a [secret]\n\nplain words follow", 3: "x [secret]\n[secret]", 4: "only [secret] here"}
    assert redact(docs).columns == docs.columns


def plain_print(t):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    body, folder = corpus
    fp = [plain_print(t or "") for _, t in body]
    root = list(range(len(body)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(body)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(body):
        low[find(i)] = min(low.get(find(i), doc), doc)
    want = sorted((doc, f"{fp[i]:016x}", low[find(i)]) for i, (doc, _) in enumerate(body))
    assert sorted(tuple(r) for r in rows(spark, folder, "op5_simhash")) == want


def test_chains_and_tiles_lose_no_link(spark):
    import random

    from cairn.llm.common import components
    from cairn.llm.simhash import links

    rng = random.Random(3)
    values = {0}
    at = 0
    for _ in range(150):  # a chain of three-bit steps, and a crowd around one value
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(at)
    values |= {at ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in components(links(frame, 3, block=16)).collect()}
    seen, groups = {}, []
    for v in values:
        if v in seen:
            continue
        group, todo = set(), [v]
        while todo:
            x = todo.pop()
            if x in group:
                continue
            group.add(x)
            todo += [y for y in values if y not in group and (x ^ y).bit_count() <= 3]
        groups.append(group)
        seen |= dict.fromkeys(group)
    for group in groups:
        if len(group) == 1:
            assert not group & got.keys()
        else:
            assert len({got[v] for v in group}) == 1
    assert len({got[next(iter(g))] for g in groups if len(g) > 1}) == sum(len(g) > 1 for g in groups)


def base(t):
    w = SPLIT.findall(t)
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_base(spark, corpus):
    body, folder = corpus
    got = rows(spark, folder, "op6_quality_rules")
    want = [(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in body for b in [base(t or "")]]
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_thresholds_hold_the_risk(spark, tmp_path):
    clean = " ".join(f"w{i}" for i in range(80))
    rows_ = [(i, clean + f" z{i}", "en") for i in range(1500)] + [(2000 + i, clean.replace(" ", " ### ") + str(i), "en") for i in range(60)] + [(3000, "## " * 60 + clean, "fr"), (3001, clean, None)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(1500)] + [(2000 + i, 0) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in rows(spark, str(tmp_path), "op6_quality_rules")}
    assert sum(not got[i] for i in range(1500)) <= 0.02 * 1500
    assert not any(got[2000 + i] for i in range(60))
    assert got[3000] and got[3001]  # strata without labels keep theirs


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 100), (3, 100), (40, 900), (7, 7)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)


@pytest.mark.parametrize("name", ["op4_secret_scans", "op5_simhash", "op6_quality_rules"])
def test_empty_tables(spark, corpus, name):
    assert rows(spark, f"{corpus[1]}/none", name) == []
