"""Registered queries against their SQL at the smallest scale, and how they are planned."""

import pytest

from prefgraph import plans

FAST = ["label_sign_weight", "flatten_annotations", "edge_flow_by_group", "triplet_rho", "margin_cycle_stats", "prompt_support_audit", "dataset_audit", "user_edge_flow", "threshold_grid_cycles", "strongest_cycles", "opening_history", "dirty_scan", "latent_beta", "bootstrap_flow", "prompt_split", "bh_qvalues", "spearman_rho", "attribute_subset_flow", "tfidf_terms", "stream_edge_flow", "label_spellings", "shard_union", "stable_sample", "prompt_group_flow", "scope_bundle", "margin_matrix", "triplet_catalogue", "row_bootstrap", "permutation_p", "sign_sanity", "safe_scope_names", "stream_triplet_rho", "user_cache", "stratum_flow"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, duck, same, name):
    same(plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", ["opening_pairs", "triplet_rho", "region_table"])
def test_no_nested_loops(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_reads_needed_columns(spark, sf):
    plan = plans.QUERIES["json_props_parse"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,props:string>" in plan


@pytest.mark.parametrize("name", ["prompt_support_audit", "aspect_disagreement"])
def test_labels_are_read_once(spark, sf, name):
    """A label's own case analysis stands in the plan once for each side of the plan, not once for each use of its sign and weight, which made code too large to compile."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-is-clearly-better WHEN") <= 4


@pytest.mark.parametrize("name", ["scope_bundle", "triplet_catalogue"])
def test_edges_are_summed_once(spark, sf, name):
    """The parts read the written edges, not the tables again."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Relation" in plan
