"""Training-data queries that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from cairn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", None])
def test_equal(spark, corpus, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'" if sf else f"CREATE VIEW {t} AS SELECT * FROM '{corpus[1]}/{t}.parquet/*.parquet'")
    frame = queries.queries()[name](spark, sf or corpus[1])
    cols = sorted(frame.columns)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*cols).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()))
