"""Every query runs on the smallest scale and agrees with its SQL twin."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from nordlys.plans import catalogue
from nordlys.session import data_dir

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import rows_of  # noqa: E402

SF = data_dir("sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if sql := catalogue.ORACLES.get(name):
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
