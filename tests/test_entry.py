"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
CORE = sorted(n for n, call in entry.queries().items() if not call.__module__.startswith("quern.llm"))


def canonical(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or str(v) in ("NaT", "<NA>", "nan") else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v.tolist() if hasattr(v, "tolist") else v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
