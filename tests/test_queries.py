"""Every query of the library against its SQL in DuckDB."""

import os

import pandas as pd
import pytest

SF = os.environ.get("MATCHLOOM_SF", "/root/testdata/sf0.001")


def shown(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(shown(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{shown(v)}" for k, v in value.items()) + "}"
    if value is None or pd.isna(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, str):
        return repr(float(value))
    return str(value)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(shown(v) for v in row) for row in frame.itertuples(index=False))


def names():
    from matchloom.plans import all_queries
    return sorted(all_queries().ORACLES)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    from matchloom.plans import all_queries
    known = all_queries()
    want = con.execute(known.ORACLES[name]).df()
    got = known.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
