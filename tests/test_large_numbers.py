"""Sums and orders far above the test tables', CSV quoting, marts that fail."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.functions.numeric import to_money
from shoplens.operators import advanced as A
from shoplens.operators import clean as C
from shoplens.operators import filters as FL
from shoplens.operators import signals as G
from shoplens.plans import bundle as BU
from shoplens.schema import RAW_FILES
from shoplens.session import work_dir
from shoplens.sources.raw import read_raw
from tests.frames import clean_frame, row


def test_money_is_kept_or_raises(spark):
    df = spark.createDataFrame([("12345678901.00",), ("x",), (None,), ("NaN",), ("1.005",)], "m string")
    assert [r[0] for r in df.select(to_money("m")).collect()] == [
        Decimal("12345678901.00"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), Decimal("1.01")]
    for big in ("1e20", "12345678901234567890.00"):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(big,)], "m string").select(to_money("m")).collect()


def test_order_total_above_ten_billion(spark):
    pay = spark.createDataFrame([("o", "9000000000.00"), ("o", "9000000000.50")], "order_id string, payment_value string")
    assert C.payments_per_order(pay).first().payment_value == Decimal("18000000000.50")


def big_days(spark, n=2400):
    """Days of 7e13 revenue each, three of them far off; all rows fit the clean schema."""
    rows = []
    for i in range(n):
        v = 70_000_000_000_000 + (i % 7) * 1_000_000_000 + (9_000_000_000_000 if i in (100, 900, 1700) else 0)
        rows.append((dt.datetime(2018, 1, 1) + dt.timedelta(days=i), Decimal(v), f"cat{i % 3}", f"st{i % 2}", f"o{i}", f"c{i}"))
    return spark.createDataFrame(rows, "order_date timestamp_ntz, payment_value decimal(18,2), product_category_name string, "
                                       "customer_state string, order_id string, customer_id string")


def test_sigma_of_large_days(spark):
    oc = big_days(spark)
    x = np.array([float(r.payment_value) for r in oc.orderBy("order_date").collect()])
    z = [r.z_score for r in G.zscore_days(G.daily_revenue_exact(oc)).orderBy("date").collect()]
    assert np.allclose(z, (x - x.mean()) / x.std())
    assert G.anomaly_count(oc).first().anomaly_count == 3 == G.signal_context(oc).first().anomaly_count
    assert A.anomaly_root_cause(oc.withColumn("review_score", F.lit(5.0))).count() == 3


def test_revenue_bounds_reach_the_reader(spark):
    path = work_dir(spark, "t-bounds")
    clean_frame(spark, [row(f"o{i}", "c", "p", "2024-01-01", i) for i in range(10)]).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df = FL.apply_filters(spark.read.parquet(path), min_revenue=2.5, max_revenue=7)
    assert sorted(int(r.payment_value) for r in df.collect()) == [3, 4, 5, 6, 7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(payment_value,2.50)" in plan and "LessThanOrEqual(payment_value,7.00)" in plan
    assert FL.apply_filters(df, min_revenue=1e17).count() == 0


RAW = {
    "orders": "order_id,customer_id,order_purchase_timestamp\no1,c1,2024-01-01 10:00:00\n",
    "order_items": "order_id,product_id,price,freight_value\no1,p1,10,1\n",
    "payments": "order_id,payment_value\no1,11\n",
    "reviews": 'review_id,order_id,review_comment_message,review_score\nr1,o1,"said ""good""\no1,1 day, fine",5\n',
    "products": "product_id,product_category_name\np1,casa\n",
    "customers": 'customer_id,customer_city,customer_state\nc1,"a ""b"", c",SP\n',
    "translations": "product_category_name,product_category_name_english\ncasa,home\n",
}


def test_quotes_and_line_ends_in_raw_files(spark, tmp_dir):
    for name, text in RAW.items():
        with open(os.path.join(tmp_dir, RAW_FILES[name]), "w") as f:
            f.write(text)
    raw = read_raw(spark, tmp_dir)
    assert [(r.order_id, r.review_comment_message, r.review_score) for r in raw["reviews"].collect()] == [
        ("o1", 'said "good"\no1,1 day, fine', "5")]
    got = C.build_orders_clean(raw).first()
    assert (got.customer_city, got.customer_state, got.review_score) == ('a "b", c', "SP", 5)
    with pytest.raises(FileNotFoundError):
        read_raw(spark, tmp_dir + "/none")


def test_median_counts_repeated_dimension_keys(spark):
    """Two rows for one customer double that order's weight, as in the joined rows."""
    raw = {
        "orders": spark.createDataFrame([("a", "c1", "2024-01-01"), ("b", "c2", "2024-01-01"), ("d", "c3", "2024-01-02")],
                                        "order_id string, customer_id string, order_purchase_timestamp string"),
        "order_items": spark.createDataFrame([("a", "p", "1", "1"), ("b", "p", "1", "1"), ("b", "q", "1", "1"), ("d", "p", "1", "1")],
                                             "order_id string, product_id string, price string, freight_value string"),
        "payments": spark.createDataFrame([("a", "1")], "order_id string, payment_value string"),
        "reviews": spark.createDataFrame([("a", "1"), ("b", "4")], "order_id string, review_score string"),
        "products": spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x")], "product_id string, product_category_name string"),
        "customers": spark.createDataFrame([("c1", "x", "y")] * 4 + [("c2", "x", "y")], "customer_id string, customer_city string, customer_state string"),
        "translations": spark.createDataFrame([("x", "X")], "product_category_name string, product_category_name_english string"),
    }
    joined = C.join_sources(raw).agg(F.median("review_score")).first()[0]
    assert C.review_median(raw).first()[0] == joined == 1.0


def test_failed_mart_is_listed_and_empty(spark, monkeypatch):
    oc = clean_frame(spark, [row("o1", "c", "p", "2024-01-01", 1)])
    monkeypatch.setattr(BU.M, "geo_analysis", lambda oc, **f: oc.select(F.raise_error(F.lit("broken")).cast("string").alias("state")))
    out = work_dir(spark, "t-marts")
    status = BU.materialize_marts(spark, oc, out)
    assert "broken" in status["geo_analysis"] and status["metrics"] == "ok" and len(status) == 20
    listed = {r.mart: (r.status == "ok", r.rows) for r in BU.mart_status(spark, out, status).collect()}
    assert listed["geo_analysis"] == (False, 0) and listed["model_metrics"] == (True, 1)
    assert spark.read.parquet(f"{out}/geo_analysis").columns == ["state"]
    monkeypatch.setattr(BU.M, "metrics", lambda oc, **f: oc.select(F.raise_error(F.lit("broken")).cast("string").alias("x")))
    with pytest.raises(Exception, match="broken"):
        BU.materialize_marts(spark, oc, out)
