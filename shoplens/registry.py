"""Registered queries over the given test tables, and their SQL twins.

Each query is ``(spark, sf_dir) -> DataFrame``. All of them start from the
clean fact built by the real clean step from the test tables
(``sources.testdata`` mapping -> ``operators.clean``). The clean fact is
written once per session and data folder into the shared checkpoint folder
(S2) and scanned back (S3), as a deployment would keep its clean table.

``ORACLE`` holds, per query, an ANSI SQL statement DuckDB can run on the
same parquet tables; it rebuilds the clean fact from scratch (``OC_SQL``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplens.operators.clean import build_orders_clean
from shoplens.session import shuffles_dropped, work_dir
from shoplens.sources.clean_store import read_clean, write_clean
from shoplens.sources.testdata import raw_from_testdata

Query = Callable[[SparkSession, str], DataFrame]

_CLEAN_CACHE: dict[tuple[str, str], str] = {}


def clean_fact_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_orders_clean(raw_from_testdata(spark, sf_dir))


def clean_table_path(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CLEAN_CACHE:
        path = work_dir(spark, "orders_clean")
        with shuffles_dropped(spark):
            write_clean(clean_fact_uncached(spark, sf_dir), path)
        _CLEAN_CACHE[key] = path
    return _CLEAN_CACHE[key]


def clean_fact(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The clean fact (11 columns + ``order_month`` partition column)."""
    return read_clean(spark, clean_table_path(spark, sf_dir), columns)


# ---- the clean fact in SQL (DuckDB dialect) ------------------------------------

OC_SQL = """
pay AS (SELECT CAST(l_orderkey AS VARCHAR) AS k,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS payment_value
        FROM lineitem GROUP BY l_orderkey),
rev AS (SELECT CAST(l_orderkey AS VARCHAR) AS k,
               ROUND_EVEN(AVG(CAST(1 + l_linenumber % 5 AS DOUBLE)), 0) AS review_score
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
j AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
             CAST(l_partkey AS VARCHAR) AS product_id, o_orderdate AS order_date,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
             CAST(l_quantity AS DECIMAL(18,2)) AS freight_value,
             CAST(COALESCE(pay.payment_value, 0) AS DECIMAL(18,2)) AS payment_value,
             rev.review_score,
             CASE WHEN p_type <> 'ECONOMY' THEN LOWER(p_type) ELSE 'unknown' END AS product_category_name,
             COALESCE(c_mktsegment, 'unknown') AS customer_city,
             COALESCE(n_name, 'unknown') AS customer_state
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      LEFT JOIN part ON l_partkey = p_partkey
      LEFT JOIN pay ON pay.k = CAST(o_orderkey AS VARCHAR)
      LEFT JOIN rev ON rev.k = CAST(o_orderkey AS VARCHAR)
      LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey),
med AS (SELECT MEDIAN(review_score) AS m FROM j),
numbered AS (SELECT j.*, ROW_NUMBER() OVER (PARTITION BY order_id, customer_id, product_id, order_date
                                           ORDER BY price, freight_value) AS rn FROM j),
oc AS (SELECT order_id, customer_id, product_id, order_date, price, freight_value, payment_value,
              CAST(ROUND_EVEN(COALESCE(review_score, med.m, 0), 0) AS INTEGER) AS review_score,
              product_category_name, customer_city, customer_state
       FROM numbered CROSS JOIN med WHERE rn = 1)
"""


def with_oc(body: str, extra_ctes: str = "") -> str:
    """``WITH <clean fact CTEs>[, extra] <body>``."""
    ctes = OC_SQL.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco
