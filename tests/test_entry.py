"""The registered queries on the smallest data, a part of them against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = Path(os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test data")
CHECKED = (
    "sp_statistics as_counts tp_statistics tl_contiguous_runs ob_active_boxes ev_multilabel rv_agreement tk_components rc_sweep"
).split()


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(SMALL))
    result = con.sql(entry.oracle_sql()[name])
    assert _sorted(df.columns, [tuple(r) for r in df.collect()]) == _sorted(result.columns, result.fetchall())
