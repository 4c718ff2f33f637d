"""Registered queries against their SQL on DuckDB.

A spread of operators runs by default; BEATLOOM_FULL=1 runs every query, as does tests/check.py.
"""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
CORE = [
    "a03_lane_usage", "p09_map_lane_runtime", "g01_fallback_grid", "w01_bar_numbers", "j02_nearest_anchor", "j15_nearest_beat", "w05_collapse_duplicates",
    "g04_shape_events", "a01_a11_chart_metrics", "g09_evaluate", "g12_lint", "p06_p24_project_hits", "p13_normalize_analysis", "j12_arbitrate", "j09_compare_positions",
    "a19_g15_lane_audit", "a26_peak_threshold", "w21_promote_kicks", "s09_append_ledger", "g20_job_state", "st03_stream_job_state",
]
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = list(SQL) if os.environ.get("BEATLOOM_FULL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    err, _ = compare(QUERIES[name](spark, SF), connect(SF), SQL[name])
    assert not err, err


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
