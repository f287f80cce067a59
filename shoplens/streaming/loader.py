"""X1..X4: consume batch files as a stream and upsert them.

* X1 — a file stream over the batch folder; ``maxFilesPerTrigger`` paces it.
* X3 — ``foreachBatch`` cleans each micro-batch (P8) and appends it to a log,
  each row with its batch index, in a folder named after the epoch: appending
  costs as much as the micro-batch holds, and a micro-batch that is run again
  overwrites its own folder. :func:`compact` merges the log into the clean
  table in one keyed upsert (S7); of rows with the same key the highest batch
  index wins, in whatever order the files came. So an ingest rewrites each
  touched month once, not once for each micro-batch.
* X2 — the pointer is the index of the next batch to load: the lowest one of
  which not all rows have been consumed. Each epoch notes the rows that it
  took of each batch, next to the checkpoint, before it commits.
* X4 — optional callbacks, after each micro-batch (its statistics) and after
  each compaction (refresh marts, retrain the model).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoplens.operators.clean import prepare_batch
from shoplens.schema import CLEAN_SCHEMA
from shoplens.session import path_exists, remove_path, shuffles_dropped
from shoplens.sources.batches import BATCH_COLUMN, RANGE_COLUMN, read_batches
from shoplens.sources.upsert import finish_stage, upsert

BATCH_FILE_SCHEMA = T.StructType([*CLEAN_SCHEMA.fields, T.StructField(BATCH_COLUMN, T.IntegerType()),
                                  T.StructField(RANGE_COLUMN, T.IntegerType())])
LOG_SCHEMA = T.StructType([*CLEAN_SCHEMA.fields, T.StructField(BATCH_COLUMN, T.IntegerType())])

OnBatch = Callable[[SparkSession, str, int, dict], None]


def _log(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-log"


def _progress(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-progress"


def stream_batches(spark: SparkSession, batch_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The batch folder as an unbounded table (explicit schema, no inference)."""
    return (spark.readStream.schema(BATCH_FILE_SCHEMA)
            .option("maxFilesPerTrigger", int(files_per_trigger))
            .parquet(batch_dir).drop(RANGE_COLUMN))


def log_stream(spark: SparkSession, batch_dir: str, checkpoint: str, on_batch: OnBatch | None = None,
               files_per_trigger: int = 1, available_now: bool = True, target_path: str = "") -> StreamingQuery:
    """X1 + X2 + X3: start the stream into the log; returns the running query."""

    def process(df: DataFrame, epoch_id: int) -> None:
        with shuffles_dropped(df.sparkSession):
            (prepare_batch(df, keep=(BATCH_COLUMN,)).write.mode("overwrite")
             .parquet(f"{_log(checkpoint)}/epoch={epoch_id}"))
            (df.groupBy(BATCH_COLUMN).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
             .parquet(f"{_progress(checkpoint)}/epoch={epoch_id}"))
        if on_batch is not None:
            rows = spark.read.parquet(f"{_progress(checkpoint)}/epoch={epoch_id}").agg(F.sum("rows")).first()[0]
            on_batch(spark, target_path, epoch_id, {"rows_in": rows or 0})

    writer = (stream_batches(spark, batch_dir, files_per_trigger).writeStream
              .foreachBatch(process)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def compact(spark: SparkSession, target_path: str, checkpoint: str) -> dict | None:
    """Merge the log into the table, then remove it; None without a log.

    Dying in between does no harm: the upsert is finished or done again from
    the same rows. Call it while the stream isn't running.
    """
    finish_stage(spark, target_path)
    if not path_exists(spark, _log(checkpoint)):
        return None
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{_log(checkpoint)}/epoch=*")
    with shuffles_dropped(spark):
        stats = upsert(spark, target_path, log, order_col=BATCH_COLUMN)
    remove_path(spark, _log(checkpoint))
    return stats


def ingest(spark: SparkSession, batch_dir: str, target_path: str, checkpoint: str, on_batch: OnBatch | None = None,
           on_compact: OnBatch | None = None, files_per_trigger: int = 1) -> int:
    """Load all pending batch files into the table; returns the pointer."""
    log_stream(spark, batch_dir, checkpoint, on_batch, files_per_trigger, target_path=target_path).awaitTermination()
    stats = compact(spark, target_path, checkpoint)
    pointer = next_batch(spark, batch_dir, checkpoint)
    if on_compact is not None and stats is not None:
        on_compact(spark, target_path, pointer, stats)
    return pointer


def consumed_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id, rows): rows consumed of each batch so far."""
    if not path_exists(spark, _progress(checkpoint)):
        return spark.createDataFrame([], f"{BATCH_COLUMN} int, rows long")
    return (spark.read.schema(f"{BATCH_COLUMN} int, rows long").parquet(f"{_progress(checkpoint)}/epoch=*")
            .groupBy(BATCH_COLUMN).agg(F.sum("rows").alias("rows")))


def batch_progress(spark: SparkSession, batch_dir: str, checkpoint: str) -> DataFrame:
    """(batch_id, rows, consumed) of each batch of the folder."""
    sizes = read_batches(spark, batch_dir).groupBy(BATCH_COLUMN).agg(F.count(F.lit(1)).alias("rows"))
    done = consumed_batches(spark, checkpoint).withColumnRenamed("rows", "consumed")
    return sizes.join(done, BATCH_COLUMN, "left").withColumn("consumed", F.coalesce("consumed", F.lit(0)))


def next_batch(spark: SparkSession, batch_dir: str, checkpoint: str) -> int:
    """The lowest batch of which rows are pending; the number after the last if none is."""
    row = batch_progress(spark, batch_dir, checkpoint).agg(
        F.min(F.when(F.col("consumed") < F.col("rows"), F.col(BATCH_COLUMN))), F.max(BATCH_COLUMN)).first()
    if row[0] is not None:
        return row[0]
    return 0 if row[1] is None else row[1] + 1


def refresh_after_batch(marts_dir: str | None = None, model_dir: str | None = None, partials_dir: str | None = None,
                        **filters) -> OnBatch:
    """After each compaction, rewrite the marts and/or retrain the model
    from the updated table (the dashboard and the forecast read the latest).

    Monthly partials (``partials_dir``, by default beside the marts) are made anew for
    the months that the compaction touched; tables and series are merged from them."""
    from shoplens.plans import partials as PT
    from shoplens.plans.bundle import materialize_marts
    from shoplens.plans.forecast import train_and_save
    from shoplens.sources.clean_store import read_clean

    def callback(spark: SparkSession, target_path: str, pointer: int, stats: dict) -> None:
        partials = partials_dir or f"{(marts_dir or model_dir).rstrip('/')}-partials"
        stats["months_refreshed"] = PT.refresh(spark, target_path, partials)
        if model_dir:
            train_and_save(PT.load(spark, partials)[0], model_dir)
        if marts_dir:
            oc = read_clean(spark, target_path)
            stats["marts"] = materialize_marts(spark, oc, marts_dir, model_dir=model_dir, partials=partials, **filters)

    return callback
