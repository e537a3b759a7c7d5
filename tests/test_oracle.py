"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "monthly_trend", "monthly_agg", "mode_breakdown", "risk_heatmap", "entity_risk", "error_diagnostics", "check_schema", "null_profile",
    "quality_score", "impute_median", "impute_ffill_bfill", "iqr_outliers", "expanding_target_rate", "lag_1_7_30", "inventory_signals",
    "supplier_rates", "frequency_encode", "split_dates", "chronological_split", "post_shipment", "json_history_append", "extract_products",
    "edges_stored_in", "graph_statistics", "bfs", "shortest_path", "pagerank", "dependency_rank", "causal_chain_confidence", "sequence_count",
    "pattern_upsert", "edge_decay", "roc_auc", "walk_forward", "leakage_audit", "memory_stats", "match_forecast_exact", "except_unmatched",
    "node_upsert", "agent_context", "cosine_topk", "grounding_score", "sink_increment", "stream_sliding_window", "late_data_side_table",
]


def test_registry_is_consistent():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 270


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    con.close()
    assert got == want
