"""Marts merged from monthly partials equal those of the fact, whatever was upserted."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shoplens.plans import bundle as BU
from shoplens.plans import partials as PT
from shoplens.session import remove_path, work_dir
from shoplens.sources.clean_store import read_clean, write_clean
from shoplens.sources.upsert import upsert
from tests.frames import clean_frame, row


def fact(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        at = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(150))
        rows.append(row(f"o{k % 170}", rnd.choice(["Unknown", "hot", *(f"c{i}" for i in range(20))]), f"p{k}", str(at), round(rnd.random() * 90, 2)))
    return (clean_frame(spark, rows).withColumn("product_category_name", F.concat(F.lit("k"), F.length("order_id").cast("string")))
            .withColumn("customer_state", F.when(F.col("customer_id") == "hot", "SP").otherwise("RJ")))


def tables(plans):
    return {name: sorted(map(str, plan().collect())) for name, plan in plans.items()}


FILTERS = [{}, {"start_date": "2024-02-03", "end_date": "2024-04-01"}, {"category": "k3"}, {"state": "SP", "category": ""},
           {"min_revenue": 10}, {"max_revenue": 0}, {"start_date": "2031-01-01"}]


@pytest.fixture(scope="module")
def store(spark):
    target, partials = work_dir(spark, "t-partials"), work_dir(spark, "t-partials-dir")
    df = fact(spark)
    write_clean(df, target)
    assert len(PT.refresh(spark, target, partials)) == 5 and PT.refresh(spark, target, partials) == []
    march = df.where("order_date >= '2024-03-05' AND order_date < '2024-03-15'")
    late = march.limit(3).withColumn("order_date", F.col("order_date") + F.expr("INTERVAL 40 DAYS"))  # an order over two months
    upsert(spark, target, march.withColumn("payment_value", (F.col("payment_value") * 3).cast("decimal(18,2)")).unionByName(late))
    made = PT.refresh(spark, target, partials)
    assert made == ["order_month=2024-03-01", "order_month=2024-04-01"]
    return target, partials


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_every_table_is_the_same(spark, store, filters):
    oc = read_clean(spark, store[0])
    whole, merged = BU.mart_plans(oc, **filters), BU.mart_plans(oc, partials=store[1], **filters)
    assert list(whole) == list(merged)
    assert tables(merged) == tables(whole)


def test_only_touched_months_are_read(spark, store):
    plan = PT.touched(spark, store[0], ["order_month=2024-03-01"])
    assert {r[0] for r in plan.select(F.col("_metadata.file_path")).distinct().collect()} and plan.select("order_month").distinct().count() == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "2024" not in text.split("PushedFilters")[1].split("ReadSchema")[0]
    assert len(plan.inputFiles()) >= 1
    merged = BU.mart_plans(read_clean(spark, store[0]), partials=store[1])
    for name in ("metrics", "daily_orders", "churn_risk", "cohort_retention", "anomalies", "filter_summary"):
        assert not any(store[0] in f for f in merged[name]().inputFiles())


def test_a_dead_refresh_is_done_again(spark, store, monkeypatch):
    target, partials = work_dir(spark, "t-dead"), work_dir(spark, "t-dead-dir")
    write_clean(fact(spark, 60), target)
    PT.refresh(spark, target, partials)
    before = PT.load(spark, partials)[0].agg(F.sum("payment_value")).first()[0]
    upsert(spark, target, fact(spark, 5, seed=9).withColumn("order_id", F.concat("order_id", F.lit("-new"))))
    with monkeypatch.context() as m:
        m.setattr(PT, "orders", lambda oc: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            PT.refresh(spark, target, partials)
    assert PT.refresh(spark, target, partials)
    c, o = PT.load(spark, partials)
    want = read_clean(spark, target).agg(F.sum("payment_value")).first()[0]
    assert c.agg(F.sum("payment_value")).first()[0] == o.agg(F.sum("payment_value")).first()[0] == want != before


def test_months_that_are_gone(spark):
    target, partials = work_dir(spark, "t-gone"), work_dir(spark, "t-gone-dir")
    write_clean(fact(spark, 80), target)
    PT.refresh(spark, target, partials)
    remove_path(spark, f"{target}/order_month=2024-02-01")
    assert PT.refresh(spark, target, partials) == []
    assert PT.load(spark, partials)[0].where("order_month = '2024-02-01'").count() == 0
    assert tables(BU.mart_plans(read_clean(spark, target), partials=partials)) == tables(BU.mart_plans(read_clean(spark, target)))
