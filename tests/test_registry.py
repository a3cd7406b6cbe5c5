"""Contract of the driver's entry file, a few oracle comparisons, and plan shapes."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check
from tallyforge.operators import lookup as L
from tallyforge.workload.q_lookup import inputs

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle_and_none_is_left_over():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert set(entry.oracle_sql()) - set(entry.LLM_ORACLES) == own
    assert set(entry.LLM_ORACLES) <= set(entry.LLM_QUERIES)
    assert len(entry.queries()) >= 90


@pytest.mark.parametrize("name", ["egress_costs", "vm_skus", "hourly_cost_per_sku", "uptime_intervals", "shutdown_list",
                                  "budget_status", "action_plan", "flatten_vm_inventory"])
def test_small_scale_oracle(spark, name):
    con = check.connect(SF)
    assert check.compare(spark, con, name, SF).startswith("ok")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_machines_are_not_shuffled_for_prices(spark):
    i = inputs(spark, SF)
    card = L.rate_card(i.vms, i.prices, i.mappings)
    plan = L.vm_skus(i.vms, card)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # past the threshold the same code shuffles instead of broadcasting
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.vm_skus(i.vms, card)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "hashpartitioning" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["last_n_charges", "reconcile_charges", "shutdown_list", "uptime_intervals", "inventory_gap",
                                  "weekly_throttle", "egress_costs"])
def test_no_single_partition_or_pairwise_plan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_rank_limit_is_applied_before_the_shuffle(spark):
    plan = entry.queries()["last_n_charges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["scan_billing_export", "last_n_charges", "reconcile_charges", "budget_status"])
def test_registered_queries_read_few_billing_dates(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(export_date" in plan


def test_price_tables_scan_the_export_once(spark):
    from tallyforge.plans.price_tables import all_prices, build_price_tables
    from tallyforge.workload.landing import sku_export

    plan = all_prices(build_price_tables(sku_export(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert "geo_taxonomy" not in plan and "tiered_rates" not in plan
