"""Every registered query against its SQL on the smallest sample tables."""

import os
from pathlib import Path

import pytest
from compare import difference, oracle_connection

import __spark_entry__ as entry
from tidemark.plans import bindings

SF_DIR = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
BRANCH_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, con, entry.oracle_sql()[name]) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert "brent_pct_3d" in frame.columns and frame.count() > 0



@pytest.mark.parametrize(
    "name, column, labels",
    [
        ("dominance_label", "dominant", {"LNG-dominant", "Oil-dominant", "mixed/low"}),
        ("implied_inverse_daily", "basis_regime", None),
        ("event_impact_phase", "phase", {*bindings.PHASE_OF_STATUS.values(), "unassigned"}),
        ("event_impact_regime", "regime", {"high_gas", "low_gas", "unknown"}),
        ("spread_daily", "regime", {"high_gas", "low_gas", "unknown"}),
        ("stream_open_days", "open", {True, False}),
        ("dual_signal_daily", "n_kharg IS NULL", {True, False}),
    ],
)
def test_sample_tables_reach_every_branch(name, column, labels):
    con = oracle_connection(BRANCH_DIR)
    sql = entry.oracle_sql()[name]
    found = {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({sql})").fetchall()}
    assert found == labels if labels else len(found) > 1
    assert con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()['spike_days']})").fetchone()[0]


def test_events_grow_with_the_orders_and_share_dates():
    sizes = []
    for sf in (SF_DIR, BRANCH_DIR):
        con = oracle_connection(sf)
        sql = entry.oracle_sql()["event_impact"]
        n, days = con.execute(f"SELECT COUNT(*), COUNT(DISTINCT event_date) FROM ({sql})").fetchone()
        sizes.append(n)
    assert sizes[1] > 5 * sizes[0] and days < n
