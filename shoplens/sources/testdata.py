"""Map the TPC-H-style test tables onto the seven raw source tables.

The mapping (documented in FIXTURES.md) feeds the *real* clean step, so the
whole ingest path runs on the given data and grows with it:

* orders       <- orders      (o_orderkey, o_custkey, o_orderdate)
* order_items  <- lineitem    (l_orderkey, l_partkey, l_extendedprice, l_quantity)
* payments     <- lineitem    one payment per line (l_orderkey, l_extendedprice)
* reviews      <- lineitem    lines with l_returnflag = 'R', score 1 + l_linenumber % 5
* products     <- part        (p_partkey, p_type)
* translations <- part        each distinct p_type except 'ECONOMY' -> lower(p_type)
* customers    <- customer ⟕ nation (c_custkey, c_mktsegment, n_name)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.schema import MONEY

# FIXED VALUES of the test mapping
UNTRANSLATED_TYPE = "ECONOMY"
REVIEW_FLAG = "R"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_from_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")

    return {
        "orders": orders.select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderdate").alias("order_purchase_timestamp")),
        "order_items": lineitem.select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
            F.col("l_quantity").cast(MONEY).alias("freight_value")),
        "payments": lineitem.select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_extendedprice").alias("payment_value")),
        "reviews": lineitem.where(F.col("l_returnflag") == REVIEW_FLAG).select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            (F.lit(1) + F.col("l_linenumber") % 5).cast("double").alias("review_score")),
        "products": part.select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_type").alias("product_category_name")),
        "translations": part.where(F.col("p_type") != UNTRANSLATED_TYPE)
            .select(F.col("p_type").alias("product_category_name")).distinct()
            .select("product_category_name",
                    F.lower("product_category_name").alias("product_category_name_english")),
        "customers": customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state")),
    }
