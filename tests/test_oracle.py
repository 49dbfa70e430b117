"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from ledgerline.registry import QUERIES  # noqa: E402
from tools.compare import digest, duck  # noqa: E402

SF = os.environ.get("LEDGERLINE_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()
QS = {name: build for name, build in E.queries().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QS))
def test_query_matches_oracle(spark, con, name):
    df = QS[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        pytest.skip("no SQL oracle for this query")
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns
