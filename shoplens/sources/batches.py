"""Cut the clean fact into numbered batches and load one.

Row batches need a global position. The sorted rows are written once, each
with its partition's number and its place in it; a count per partition then
gives every row its position when the table is read. Daily batches only number
the distinct days (a calendar-bounded table) and join that index back.

On storage ``RANGE`` batches share a folder (``batch_range``), and
``batch_id`` is a sorted column in it: a thousand times fewer folders than
batches, and the reader still skips to one batch by the files' statistics.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import day
from shoplens.functions.numbering import global_row_number
from shoplens.schema import DEFAULT_BATCH_SIZE
from shoplens.session import folders_as_they_come, shuffles_dropped

BATCH_COLUMN = "batch_id"
POSITION_COLUMN = "_pos"
RANGE_COLUMN = "batch_range"
RANGE = 1000
#: a row group of a cut's files: a micro-batch of one file is read by several tasks, one
#: batch without the rest of its file
ROW_GROUP_BYTES = 8 << 20
# total order for numbering: date first, then the full de-duplication key
BATCH_ORDER = ["order_date", "order_id", "product_id", "customer_id"]


def number_rows(oc: DataFrame) -> DataFrame:
    """Rows sorted by date, with their position: for several cuts of the same rows."""
    return global_row_number(oc.where(F.col("order_date").isNotNull()), BATCH_ORDER, POSITION_COLUMN)


def split_row_batches(oc: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Sort by date, number rows (unless :func:`number_rows` did), batch = floor(position / size)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than 0")
    numbered = oc if POSITION_COLUMN in oc.columns else number_rows(oc)
    return (numbered.withColumn(BATCH_COLUMN, F.floor((F.col(POSITION_COLUMN) - 1) / F.lit(batch_size)).cast("int"))
            .drop(POSITION_COLUMN))


def split_daily_batches(oc: DataFrame) -> DataFrame:
    """One batch per order day, dense 0-based index in date order."""
    rows = oc.where(F.col("order_date").isNotNull()).withColumn("_day", day("order_date"))
    days = rows.select("_day").distinct()
    index = days.select("_day", (F.row_number().over(Window.orderBy("_day")) - 1).cast("int").alias(BATCH_COLUMN))
    return rows.join(index, "_day").drop("_day")


def write_batches(batched: DataFrame, path: str, in_order: bool = False) -> None:
    """Write a cut; whatever an earlier cut left in ``path`` goes.

    ``in_order`` says that the rows are read from sorted files, as those of
    :func:`split_row_batches` are: a task then holds few ranges and writes them as
    they come, without another shuffle and sort."""
    rows = batched.withColumn(RANGE_COLUMN, F.floor(F.col(BATCH_COLUMN) / F.lit(RANGE)).cast("int"))
    if not in_order:
        rows = rows.hint("rebalance", RANGE_COLUMN).sortWithinPartitions(RANGE_COLUMN, BATCH_COLUMN)
    with shuffles_dropped(rows.sparkSession), folders_as_they_come(rows.sparkSession) if in_order else nullcontext():
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .option("parquet.block.size", ROW_GROUP_BYTES)
         .partitionBy(RANGE_COLUMN).parquet(path))


def read_batches(spark: SparkSession, batch_dir: str) -> DataFrame:
    """All rows of a cut, with their ``batch_id``."""
    return spark.read.parquet(batch_dir).drop(RANGE_COLUMN)


def read_batch(spark: SparkSession, batch_dir: str, batch_idx: int) -> DataFrame:
    """One batch: its folder only, and in it the row groups that hold it."""
    i = int(batch_idx)
    return (spark.read.parquet(batch_dir).where((F.col(RANGE_COLUMN) == i // RANGE) & (F.col(BATCH_COLUMN) == i))
            .drop(BATCH_COLUMN, RANGE_COLUMN))


# FIXED VALUE: file names of a batch folder written one CSV per batch
BATCH_FILE_PATTERN = r"batch_(\d+)\.csv"


def _file_index(name: Column) -> Column:
    index = F.regexp_extract(name, f"^{BATCH_FILE_PATTERN}$", 1)
    return F.when(index != "", index.cast("int"))


def read_batch_files(spark: SparkSession, batch_dir: str) -> DataFrame:
    """Batch folders laid out as ``batch_<n>.csv`` files: all rows, with the
    batch index taken from each row's file name (``regexp_extract``).
    A file whose name does not follow the pattern gets a NULL index, which
    ``validate.check_batch_files`` reports."""
    df = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
          .csv(f"{batch_dir.rstrip('/')}/batch_*.csv"))
    return df.withColumn(BATCH_COLUMN, _file_index(F.col("_metadata.file_name")))


def batch_file_sizes(spark: SparkSession, batch_dir: str) -> DataFrame:
    """(batch_id, rows) of each ``batch_*.csv`` file, those without a row included.

    The names come from a listing, as Spark's readers pass over files of no
    length; the readers list them on the driver all the same."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{batch_dir.rstrip('/')}/batch_*.csv")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = spark.createDataFrame([(s.getPath().getName(),) for s in fs.globStatus(pattern)], "file string")
    rows = (read_batch_files(spark, batch_dir).select(F.col("_metadata.file_name").alias("file"))
            .groupBy("file").agg(F.count(F.lit(1)).alias("rows")))
    return listed.join(rows, "file", "left").select(
        _file_index(F.col("file")).alias(BATCH_COLUMN), F.coalesce("rows", F.lit(0)).alias("rows"))


def load_batch(spark: SparkSession, batch_dir: str, batch_idx: int, target_path: str | None = None,
               dry_run: bool = False) -> int:
    """Dry run -> raw row count of the batch, nothing written; else upsert.

    An empty (or missing) batch is an error, and so is one without a valid row.
    """
    from shoplens.operators.clean import prepare_batch
    from shoplens.sources.upsert import upsert

    batch = read_batch(spark, batch_dir, batch_idx)
    n = batch.count()
    if n == 0:
        raise ValueError(f"batch {batch_idx} has no rows in {batch_dir}")
    if dry_run:
        return n
    if target_path is None:
        raise ValueError("target_path is required unless dry_run")
    loaded = upsert(spark, target_path, prepare_batch(batch))["rows_upserted"]
    if loaded == 0:
        raise ValueError(f"batch {batch_idx} has no valid rows")
    return loaded
