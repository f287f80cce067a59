"""Validation operators (V1..V3) as one-row / small DataFrames.

Each check is a single aggregate pass; ``raise_if_failed`` turns the
one-row result into an exception for pipelines that must stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shoplens.schema import PK_COLUMNS
from shoplens.sources.batches import BATCH_COLUMN, batch_file_sizes
from shoplens.sources.clean_store import read_clean, write_clean


def check_clean(oc: DataFrame) -> DataFrame:
    """V1: rows, NULL order ids, unparseable dates, extra rows on the PK.

    One scan: counts per key first, their sums after."""
    groups = oc.groupBy(*PK_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (groups.agg(
                total("n").alias("rows"),
                total(F.when(F.col("order_id").isNull(), F.col("n"))).alias("null_order_ids"),
                total(F.when(F.col("order_date").isNull(), F.col("n"))).alias("invalid_dates"),
                total(F.col("n") - 1).alias("duplicate_rows"))
            .withColumn("passed", (F.col("rows") > 0) & (F.col("null_order_ids") == 0)
                        & (F.col("invalid_dates") == 0) & (F.col("duplicate_rows") == 0)))


def write_checked(oc: DataFrame, path: str) -> DataFrame:
    """Write the clean table (S2) and check it (V1) in flight: the row of
    :func:`check_clean`, of which rows, NULL ids and bad dates are counted by the writing
    tasks themselves. Only the duplicate test reads again, the key columns alone."""
    seen = Observation()
    write_clean(oc, path, watch=lambda df: df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("order_id").isNull(), 1)).alias("null_order_ids"),
        F.count(F.when(F.col("order_date").isNull(), 1)).alias("invalid_dates")))
    counted = seen.get
    stored = read_clean(oc.sparkSession, path, PK_COLUMNS, keep_partition=False) if counted["rows"] else oc.select(*PK_COLUMNS).limit(0)
    keys = stored.groupBy(*PK_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return (keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
            .select(*(F.lit(counted[c]).cast("bigint").alias(c) for c in ("rows", "null_order_ids", "invalid_dates")), "duplicate_rows")
            .withColumn("passed", (F.col("rows") > 0) & (F.col("null_order_ids") == 0)
                        & (F.col("invalid_dates") == 0) & (F.col("duplicate_rows") == 0)))


def batch_summary(batched: DataFrame) -> DataFrame:
    """Per-batch row counts (one row per batch)."""
    return batched.groupBy(BATCH_COLUMN).agg(F.count(F.lit(1)).alias("rows"))


def check_batches(batched: DataFrame, source: DataFrame, batch_size: int | None) -> DataFrame:
    """V2 over the rows of a cut: ids contiguous from 0; non-final batches
    exactly ``batch_size`` (None: any size, as daily batches have); the final
    one at most that; totals equal the source; no row without a batch index."""
    return check_batch_sizes(batch_summary(batched), source, batch_size)


def check_batch_files(spark: SparkSession, batch_dir: str, source: DataFrame, batch_size: int | None) -> DataFrame:
    """V2 over a folder of ``batch_<n>.csv`` files: the files are listed, so
    that one without any row is found too; ``invalid_names`` counts the files
    whose names carry no index."""
    return check_batch_sizes(batch_file_sizes(spark, batch_dir), source, batch_size, per_file=True)


def check_batch_sizes(sizes: DataFrame, source: DataFrame, batch_size: int | None, per_file: bool = False) -> DataFrame:
    """V2 from (batch_id, rows), one row a batch.

    The number of batches grows with the data, so nothing here is a window
    over all batches: contiguity is ``span == distinct ids`` and the last
    batch is found through the one-row maximum id.
    """
    if batch_size is not None and batch_size <= 0:
        raise ValueError("batch_size must be greater than 0")
    no_name = F.col(BATCH_COLUMN).isNull()
    invalid = sizes.agg(F.coalesce(F.sum(F.when(no_name, F.lit(1) if per_file else F.col("rows"))), F.lit(0))
                        .cast("bigint").alias("invalid_names"))
    sizes = sizes.where(~no_name)
    last = sizes.agg(F.max(BATCH_COLUMN).alias("_last_id"))  # one row
    flagged = sizes.crossJoin(F.broadcast(last)).withColumn("_is_last", F.col(BATCH_COLUMN) == F.col("_last_id"))
    src = source.agg(F.count(F.lit(1)).alias("source_rows"))
    limit = F.lit(batch_size).cast("bigint")
    res = flagged.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.min(BATCH_COLUMN).alias("first_id"),
        (F.coalesce(F.max(BATCH_COLUMN) - F.min(BATCH_COLUMN) + 1, F.lit(0)) - F.count(F.lit(1)))
        .cast("bigint").alias("gaps"),
        F.count(F.when(F.col("rows") == 0, 1)).alias("empty_batches"),
        F.count(F.when(~F.col("_is_last") & (F.col("rows") != limit), 1)).alias("wrong_size"),
        F.max(F.when(F.col("_is_last"), F.col("rows"))).alias("last_batch_size"))
    return (res.crossJoin(src).crossJoin(invalid)
            .withColumn("passed", (F.col("total_batches") > 0) & (F.col("first_id") == 0) & (F.col("gaps") == 0)
                        & (F.col("empty_batches") == 0) & (F.col("wrong_size") == 0)
                        & F.coalesce(F.col("last_batch_size") <= limit, F.lit(True)) & (F.col("invalid_names") == 0)
                        & (F.col("total_rows") == F.col("source_rows"))))


def check_table(tbl: DataFrame) -> DataFrame:
    """V3: row count and the number of PK groups holding more than one row."""
    dups = (tbl.groupBy(*PK_COLUMNS).count().where("count > 1")
            .agg(F.count(F.lit(1)).alias("duplicate_pk_groups")))
    return tbl.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(dups)


def raise_if_failed(check: DataFrame, what: str) -> dict:
    row = check.first().asDict()
    if not row.get("passed", True):
        raise ValueError(f"{what} validation failed: {row}")
    return row


def check_translations(translations: DataFrame) -> DataFrame:
    """A NULL raw category in the translation table would match NULL
    categories in a pandas merge but never in a SQL join, so it is rejected
    here (the clean step ignores such rows)."""
    return (translations.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count(F.when(F.col("product_category_name").isNull(), 1)).alias("null_keys"))
            .withColumn("passed", F.col("null_keys") == 0))
