"""Clean step on literal raw tables (T3, T8, T9, P4..P7) and the CSV reader."""

from __future__ import annotations

import os

import pytest

from shoplens.operators import clean as C
from shoplens.sources.raw import read_raw
from shoplens.schema import RAW_FILES


def raw_tables(spark, reviews=None, orders=None, items=None):
    orders = orders or [("o1", "c1", "2024-01-01 10:00:00"), ("o2", "c2", "not a date"),
                        ("o3", "c1", "2024-01-03")]
    items = items or [("o1", "p1", "10.005", "1"), ("o1", "p1", "9.00", "2"), ("o1", "p2", "abc", None),
                      ("o2", "p1", "5", "1"), ("o3", "p3", "7.50", "0.5")]
    reviews = reviews if reviews is not None else [("o1", "2"), ("o1", "3"), ("o3", "x")]
    return {
        "orders": spark.createDataFrame(orders, "order_id string, customer_id string, order_purchase_timestamp string"),
        "order_items": spark.createDataFrame(items, "order_id string, product_id string, price string, freight_value string"),
        "payments": spark.createDataFrame([("o1", "4.5"), ("o1", "5.5"), ("o3", "bad")],
                                          "order_id string, payment_value string"),
        "reviews": spark.createDataFrame(reviews, "order_id string, review_score string"),
        "products": spark.createDataFrame([("p1", "casa"), ("p2", None), ("p3", "toys")],
                                          "product_id string, product_category_name string"),
        "translations": spark.createDataFrame([("casa", "home")],
                                              "product_category_name string, product_category_name_english string"),
        "customers": spark.createDataFrame([("c1", "rio", "RJ")], "customer_id string, customer_city string, customer_state string"),
    }


def test_clean_step_literal(spark):
    out = {(r.order_id, r.product_id): r for r in C.build_orders_clean(raw_tables(spark)).collect()}
    # o2 has an unparseable date -> dropped; o1/p1 appears twice -> the cheaper row is kept
    assert set(out) == {("o1", "p1"), ("o1", "p2"), ("o3", "p3")}
    o1p1 = out[("o1", "p1")]
    assert str(o1p1.price) == "9.00" and str(o1p1.freight_value) == "2.00"
    assert str(out[("o1", "p2")].price) == "0.00"             # bad number -> 0
    assert str(o1p1.payment_value) == "10.00"                 # order-level sum on every item row
    assert str(out[("o3", "p3")].payment_value) == "0.00"     # bad payment -> NULL sum -> 0
    assert o1p1.review_score == 2                             # mean 2.5 -> half-even 2
    assert o1p1.product_category_name == "home"
    assert out[("o1", "p2")].product_category_name == "unknown"
    assert out[("o3", "p3")].product_category_name == "unknown"  # untranslated
    assert o1p1.customer_state == "RJ"


def test_median_fill_and_all_null(spark):
    # o3's score is NULL -> median over the joined rows (o1 rows: 2, 2, 2 and o2's dropped row: none)
    out = C.build_orders_clean(raw_tables(spark)).where("order_id = 'o3'").first()
    assert out.review_score == 2
    none = C.build_orders_clean(raw_tables(spark, reviews=[("o9", "5")])).collect()
    assert {r.review_score for r in none} == {0}


def test_median_half_even(spark):
    orders = [("o1", "c1", "2024-01-01"), ("o2", "c1", "2024-01-02"), ("o3", "c1", "2024-01-03")]
    items = [("o1", "p1", "1", "1"), ("o2", "p1", "1", "1"), ("o3", "p1", "1", "1")]
    t = raw_tables(spark, reviews=[("o1", "1"), ("o2", "4")], orders=orders, items=items)
    out = {r.order_id: r.review_score for r in C.build_orders_clean(t).collect()}
    assert out["o3"] == 2  # median(1, 4) = 2.5 -> 2 (half-even)


def test_dedup_keeps_smallest(spark):
    from tests.frames import clean_frame, row
    df = clean_frame(spark, [row("o", "c", "p", "2024-01-01", 1, price="5.00"),
                             row("o", "c", "p", "2024-01-01", 1, price="3.00")])
    assert str(C.dedup_orders(df).first().price) == "3.00"


def test_prepare_batch_truncates_and_zero_fills(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("o", "c", "p", "2024-01-01", "1", "1", "1", "3.7", None, None, None),
                                ("o2", "c", "p", "2024-01-01", "1", "1", "1", None, "a", "b", "c")],
                               ",".join(f"{c} string" for c in C.CLEAN_COLUMNS))
    out = {r.order_id: r for r in C.prepare_batch(df).collect()}
    assert out["o"].review_score == 3 and out["o2"].review_score == 0
    assert out["o"].customer_state == "unknown"
    assert C.prepare_batch(df).schema["order_date"].dataType.typeName() == "timestamp_ntz"
    assert F is not None


def test_prepare_orders_unknown_rules(spark):
    df = spark.createDataFrame([("o", None, "2024-01-01", "1", None, None, "4"),
                                ("o2", "c", None, "1", None, None, "4"),
                                ("o3", "c", "2024-01-01", "x", None, None, "4")],
                               "order_id string, customer_id string, order_date string, payment_value string, "
                               "product_category_name string, customer_state string, review_score string")
    out = C.prepare_orders(df).collect()
    assert [r.order_id for r in out] == ["o3"]
    assert out[0].product_category_name == "Unknown" and str(out[0].payment_value) == "0.00"


def test_read_raw_csv_with_fallback(spark, tmp_dir):
    raw_dir, fallback = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "root")
    os.makedirs(raw_dir)
    os.makedirs(fallback)
    headers = {
        "orders": "order_id,customer_id,order_status,order_purchase_timestamp\no1,c1,ok,2024-01-01 10:00:00\n",
        "order_items": "order_id,order_item_id,product_id,seller_id,price,freight_value\no1,1,p1,s,10.5,1.25\n",
        "payments": "order_id,payment_sequential,payment_type,payment_value\no1,1,card,10.5\n",
        "reviews": "review_id,order_id,review_score\nr1,o1,5\n",
        "products": "product_id,product_category_name\np1,casa\n",
        "customers": "customer_id,customer_unique_id,customer_city,customer_state\nc1,u1,rio,RJ\n",
        "translations": "product_category_name,product_category_name_english\ncasa,home\n",
    }
    for i, (name, text) in enumerate(headers.items()):
        folder = raw_dir if i % 2 == 0 else fallback  # half the files only in the fallback folder
        with open(os.path.join(folder, RAW_FILES[name]), "w") as f:
            f.write(text)
    tables = read_raw(spark, raw_dir, fallback)
    out = C.build_orders_clean(tables).first()
    assert out.product_category_name == "home" and str(out.price) == "10.50" and out.review_score == 5
    os.remove(os.path.join(fallback, RAW_FILES["order_items"]))
    with pytest.raises(FileNotFoundError):
        read_raw(spark, raw_dir, fallback)


def test_checks_in_flight_are_those_of_the_table(spark):
    """Rows, bad dates and duplicates counted while writing; an empty table fails."""
    from pyspark.sql import functions as F

    from shoplens.operators import validate as V
    from shoplens.session import work_dir
    from shoplens.sources.clean_store import read_clean
    from tests.frames import clean_frame, row

    rows = [row(f"o{k % 30}", "c", f"p{k % 4}", f"2024-0{1 + k % 3}-01", k) for k in range(90)]
    bad = clean_frame(spark, rows).repartition(4)
    bad = bad.withColumn("order_date", F.when(F.col("payment_value") != 7, F.col("order_date"))).withColumn(
        "order_id", F.when(F.col("payment_value") != 9, F.col("order_id")))
    for k, df in enumerate((clean_frame(spark, rows[:12]), bad, bad.limit(0))):
        path = work_dir(spark, f"t-flight-{k}")
        got = V.write_checked(df, path).first()
        assert got == V.check_clean(df).first()
        assert got.passed == (k == 0)
        if k < 2:
            assert read_clean(spark, path).count() == got.rows
