"""Registered queries against their SQL, and the driver contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare
from tapewatch.plans import registry
from tests.conftest import SF, have_testdata

pytestmark = pytest.mark.skipif(not have_testdata(), reason="test tables not present")

# one query per family; check_oracles.py runs all of them
SOME = [
    "tick_index", "rolling_zscore", "wash_lookback", "surveillance", "detect", "bar_statistics", "nearest_bar",
    "ticker_metrics", "alert_rollup", "frame_diff", "latency_stats", "log_order_report", "label_scores",
    "leave_one_ticker_out", "naive_tuning", "replay_schedule",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "tick_id", "risk_score", "anomaly_type", "signals", "incident_id"]
    assert df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.COVERS) == set(registry.QUERIES) <= set(entry.queries())


def test_variants_share_the_indexed_ticks(spark, monkeypatch):
    from tapewatch.operators import inject

    calls, indexed = [], inject.indexed
    monkeypatch.setattr(inject, "indexed", lambda *a, **k: calls.append(a) or indexed(*a, **k))
    entry.queries()["inject_variants"](spark, SF)
    assert len(calls) == 1
