"""Plans: pruned and filtered scans, no products of growing tables, no Python in relational operators."""

from __future__ import annotations

import re

import pytest

from symloom import queries as Q
from symloom.plans.engine import explained

#: One side is one row or a configuration table.
NESTED = {"T7_list_functions", "A13_workspace_overview", "A15_symbol_impact", "A15_symbol_index", "A21_incremental_statistics", "A26_local_and_distributed", "S16_report", "V3_similar", "X19_layer_of_crate", "R9_dispatched", "R15_matched_patterns", "J23_diff_lookup", "G5_diff_impact", "S7_excluded", "S10_ingest_edges"}
#: They parse sources, embed text or write tables first.
PYTHON = {"S1_scan_functions", "P10_scan_calls", "S10_ingest_edges", "I9_refresh", "X13_embedding_vectors", "P3_contexts", "P6_types", "P11_macros", "P16_imports", "P18_actors", "P23_spawns", "P27_handles", "P30_sends"}
RUNS = {"I1_stream_state", "I9_refresh", "S10_write_and_read"}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - RUNS))
def test_plan(name, spark, sf):
    plan = explained(Q.QUERIES[name](spark, sf), "simple")
    assert "CartesianProduct" not in plan or name in NESTED
    assert "BroadcastNestedLoopJoin" not in plan or name in NESTED
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", plan)


def test_scans_are_pruned(spark, sf):
    plan = explained(Q.QUERIES["A6_most_referenced"](spark, sf), "simple")
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("l_orderkey" in r for r in reads) and not any("l_extendedprice" in r or "l_shipdate" in r for r in reads)
    plan = explained(Q.QUERIES["A14_crate_samples"](spark, sf), "simple")
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#7)]" in plan


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in explained(Q.QUERIES["A6_most_referenced"](spark, sf), "simple")
