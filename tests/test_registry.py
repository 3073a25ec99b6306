"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    line, ok = compare(spark, con, FOLDER, name, entry.oracle_sql()[name])
    assert ok, line


def test_registry_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", ["filter_high_coverage", "dotted_labels"])
def test_thresholds_leave_rows_at_every_scale(spark, name, scale):
    assert entry.queries()[name](spark, f"/root/testdata/sf{scale}").count() > 0
