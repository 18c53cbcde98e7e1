"""Every query with SQL against DuckDB on the smallest tables; the others for rows and properties."""

import math

import duckdb
import pytest

from tidemark.plans import exchange  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(v):
    return None if v is None else round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name]).fetchdf()
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    con = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})")
    expected = sorted((tuple(map(rounded, r)) for r in con.fetchall()), key=str)
    got = sorted((tuple(map(rounded, r)) for r in df.select(*columns).collect()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_forest_is_whole(spark, monkeypatch):
    from tidemark.operators import forest

    seen = []
    monkeypatch.setattr(forest, "score_balanced_forest", lambda nodes, df, f=forest.score_balanced_forest: (seen.append(nodes), f(nodes, df))[1])
    QUERIES["rf_fit_score"](spark, SF)
    n = seen[0].groupBy("tree").count().count()
    assert n == 100
