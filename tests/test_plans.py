"""Plan-shape checks: pruning, pushdown and shuffle placement."""

from __future__ import annotations

import __spark_entry__ as E
from shoplens.registry import clean_fact, clean_fact_uncached
from shoplens.operators import marts as M
from tests.conftest import SF_SMALL


def executed_plan(df) -> str:
    """The final (post-AQE) physical plan with untruncated scan metadata."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_prunes_month_partitions_and_columns(spark):
    df = M.metrics(clean_fact(spark, SF_SMALL), start_date="1996-01-01", end_date="1996-03-31", state="NATION_7")
    plan = executed_plan(df)
    assert "PartitionFilters: [isnotnull(order_month" in plan and "order_month#" in plan
    assert ">= 1996-01-01" in plan and "<= 1996-03-01" in plan  # month bounds reach the file index
    assert "EqualTo(customer_state,NATION_7)" in plan            # pushed to the parquet reader
    assert "product_category_name" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_clean_dedup_reuses_order_id_partitioning(spark):
    # with tiny test tables every join could be a broadcast; disable that to
    # see the plan large inputs get (sort-merge joins on their keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed_plan(clean_fact_uncached(spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the four-key de-duplication needs no exchange of its own
    assert "hashpartitioning(order_id#" in plan
    assert "Exchange hashpartitioning(order_id" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "product_id" not in line.split("hashpartitioning(")[1].split(")")[0] or \
                   "order_id" not in line.split("hashpartitioning(")[1].split(")")[0]


def test_churn_pre_aggregates_per_order(spark):
    plan = executed_plan(E.queries()["churn_risk"](spark, SF_SMALL))
    assert "Exchange hashpartitioning(customer_id#" in plan
    assert "partial_sum" in plan and "partial_max" in plan
