"""Every registered query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted(repr([plain(x) for x in r]) for r in frame.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr([plain(x) for x in r]) for r in duck.sql(f"SELECT {quoted} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
