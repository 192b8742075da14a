"""Every registered query against its SQL on the smallest data."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import registry
from compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    text, fine = compare(spark, con, SF, key, QUERIES[key], ORACLES.get(key))
    assert fine, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_month", "monthly_revenue", "order_volume", "prev_month_revenue", "mom_growth_pct"]
    assert df.count() > 0


def test_registry_needs_no_session(tmp_path):
    """The driver lists queries and SQL before it starts Spark."""
    code = f"import sys; sys.path.insert(0, {entry.ROOT!r}); import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("True"), done.stderr[-500:]
