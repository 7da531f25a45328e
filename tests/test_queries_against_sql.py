"""Every query with SQL gives the rows DuckDB gives on the small tables; every other query runs."""

import decimal
import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1:].split("_")[0].isdigit())]


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, decimal.Decimal):
        return float(v)
    return None if isinstance(v, float) and v != v else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    assert sorted(duck.sql(sql).columns) == cols
    names = ",".join(f'"{c}"' for c in cols)
    assert got == sorted(repr(tuple(plain(x) for x in r)) for r in duck.sql(f"select {names} from ({sql})").fetchall())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"split", "lang_src", "n"}
