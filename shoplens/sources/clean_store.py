"""The clean table on storage.

Stored as Parquet partitioned by ``order_month`` (DATE, first day of the
month) and sorted by date inside each file (K1). Date filters get a derived
month predicate so whole partitions are pruned at planning time.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from shoplens.functions.dates import month_start
from shoplens.schema import CLEAN_COLUMNS
from shoplens.session import folders_as_they_come, path_exists

PARTITION_COLUMN = "order_month"

DDL = """
CREATE TABLE IF NOT EXISTS {name} (
    order_id STRING NOT NULL,
    customer_id STRING NOT NULL,
    product_id STRING NOT NULL,
    order_date TIMESTAMP_NTZ NOT NULL,
    price DECIMAL(18,2) NOT NULL,
    freight_value DECIMAL(18,2) NOT NULL,
    payment_value DECIMAL(18,2) NOT NULL,
    review_score INT NOT NULL,
    product_category_name STRING NOT NULL,
    customer_city STRING NOT NULL,
    customer_state STRING NOT NULL,
    order_month DATE
) USING parquet PARTITIONED BY (order_month) LOCATION '{location}'
"""


def with_partition(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION_COLUMN, month_start("order_date"))


def write_clean(oc: DataFrame, path: str, mode: str = "overwrite", watch: Callable[[DataFrame], DataFrame] = lambda df: df,
                by_month: bool = False) -> None:
    """S2 + K1: month partitions, rows sorted by (date, key) inside each file.

    ``rebalance`` on the month lets AQE split an oversized month (one month
    may hold a third of all rows) across several writers and files instead
    of sending it to one task, and merges small months. The sort begins with
    the month as the writer asks for, which would sort once more otherwise. ``watch`` may observe
    the rows as they are written (in the writing tasks, so each row once).

    ``by_month`` says that the rows are read from a clean table: its files hold
    one month each, sorted, and are written as they come, without a shuffle or a sort (a
    file that joins several files of its month holds one sorted run of each).
    """
    rows = with_partition(oc)
    if not by_month:
        rows = rows.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(PARTITION_COLUMN, "order_date", "order_id", "product_id")
    with folders_as_they_come(oc.sparkSession) if by_month else nullcontext():
        (watch(rows)
         .write.mode(mode).option("partitionOverwriteMode", "static")  # a full write leaves no old month behind
         .partitionBy(PARTITION_COLUMN).parquet(path))


def read_clean(spark: SparkSession, path: str, columns: list[str] | None = None,
               keep_partition: bool = True) -> DataFrame:
    """S3: scan the clean table; Catalyst prunes to the selected columns."""
    df = spark.read.parquet(path)
    cols = list(columns or CLEAN_COLUMNS)
    if keep_partition and PARTITION_COLUMN in df.columns and PARTITION_COLUMN not in cols:
        cols.append(PARTITION_COLUMN)
    return df.select(*cols)


def create_table(spark: SparkSession, name: str, location: str) -> DataFrame:
    """Idempotent CREATE TABLE IF NOT EXISTS over a location; months that
    lie there already become the table's partitions."""
    spark.sql(DDL.format(name=name, location=location))
    if path_exists(spark, location):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
