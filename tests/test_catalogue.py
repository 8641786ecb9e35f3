"""Every query that has an SQL twin against it, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).fetchdf())


@pytest.fixture(scope="module")
def late_issues(tmp_path_factory):
    """The smallest tables with all parts in the issues .5 and .6, so that names end in a digit that rounds up."""
    at, c = str(tmp_path_factory.mktemp("issues")), duckdb.connect()
    late = {"part": "p_partkey", "lineitem": "l_partkey"}
    for t in TABLES:
        more = f"REPLACE (CAST({late[t]} + 11900 AS BIGINT) AS {late[t]})" if t in late else ""
        c.execute(f"COPY (SELECT * {more} FROM '{DATA}/{t}.parquet') TO '{at}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return at, c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["broker_fills", "risk_weights"])
def test_twin_of_names_with_issues(spark, late_issues, name):
    at, c = late_issues
    assert rows(catalogue.queries()[name](spark, at).toPandas()) == rows(c.execute(catalogue.oracle_sql()[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_has_rows(spark):
    df = catalogue.flagship(spark, DATA)
    assert df.count() > 0 and df.columns == ["session", "inst", "score", "reason", "ret"]
