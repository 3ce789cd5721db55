"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparkquill import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def text(v) -> str:
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["postings", "sparse_norms", "sparse_topk_label", "score_cutoff", "rag_context"])
def test_repeated_and_null_ids_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    again = f"SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id + 1 END AS doc_id) FROM '{DIR}/documents.parquet' WHERE doc_id < 40"
    con.sql(f"COPY (SELECT * FROM '{DIR}/documents.parquet' UNION ALL {again}) TO '{tmp_path}/documents.parquet'")
    con.sql(f"COPY (SELECT * FROM '{DIR}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet'")
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())
