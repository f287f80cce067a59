"""Live KPIs (A3, A4, A5, W1) from the batch stream, with retractions for overwritten keys.

The batches are keyed on the table's primary key. The row that stands for a key now
is the one of the highest batch index, whatever the order in which the files come (of
one batch the largest by its other columns, as in the upsert). A row that replaces
another one takes back its revenue; a new key adds one row and its revenue; a row that
is older than the one that stands adds nothing. Of each micro-batch these changes are
summed by day and written to a folder named after its epoch, which a repeated epoch
overwrites, so that every change counts once through failures and restarts. The KPIs are
sums over these folders: a few numbers a day and epoch.

The standing rows, as far as they decide which row of a key stands and what it adds, lie
in Parquet *runs* beside the checkpoint, sorted by date. An epoch
reads of the runs before it the days between its first and its last one, takes per key
the largest row there and the largest of all, and writes the rows that stand newly as
its own run. Every ``MERGE`` epochs their runs become one, every ``MERGE`` of these
one again, so that a row is written again a few times (by the logarithm of the number of
epochs) and an epoch reads a few runs. Which epochs a run covers follows from its number, and
runs that are merged go when a later epoch comes, so that a repeated epoch finds
what it found before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplens.functions.dates import day
from shoplens.operators.clean import prepare_batch
from shoplens.operators.marts import growth_of
from shoplens.schema import CLEAN_COLUMNS, MONEY_COLUMNS, PK_COLUMNS
from shoplens.session import path_exists, remove_path, shuffles_dropped
from shoplens.sources.batches import BATCH_COLUMN
from shoplens.streaming.loader import stream_batches

REST = [c for c in CLEAN_COLUMNS if c not in PK_COLUMNS]
#: what orders the rows of a key, up to the last column that the KPIs read: rows that only
#: differ in a later one add the same
RANK = [BATCH_COLUMN, *REST[:REST.index("payment_value") + 1]]
CHANGES = "date date, rows long, cents long"
#: runs that are merged into one
MERGE = 8


def change_stream(spark: SparkSession, batch_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The cleaned rows of the batches, each with what it adds to its day (date, rows,
    cents) if its key is new; :func:`stand` takes back what the row before it added."""
    rows = prepare_batch(stream_batches(spark, batch_dir, files_per_trigger), keep=(BATCH_COLUMN,))
    return rows.select(*PK_COLUMNS, BATCH_COLUMN, *((F.col(c) * 100).cast("long").alias(c) if c in MONEY_COLUMNS else c for c in REST),
                       day("order_date").alias("date"), F.lit(1).cast("long").alias("rows"),
                       (F.col("payment_value") * 100).cast("long").alias("cents"))


def _log(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-changes"


def _run(checkpoint: str, epoch: int) -> str:
    return f"{checkpoint.rstrip('/')}-runs/{'merged' if covered(epoch) > 1 else 'epoch'}={epoch}"


def covered(epoch: int) -> int:
    """How many epochs, up to this one, the run of ``epoch`` holds."""
    n = 1
    while (epoch + 1) % (n * MERGE) == 0:
        n *= MERGE
    return n


def live_runs(epoch: int) -> list[int]:
    """The runs that together hold all epochs up to ``epoch``, the latest first."""
    found = []
    while epoch >= 0:
        found.append(epoch)
        epoch -= covered(epoch)
    return found


def merged_runs(epoch: int) -> list[int]:
    """The earlier runs that the run of ``epoch`` takes up."""
    return [e for e in live_runs(epoch - 1) if e > epoch - covered(epoch)]


def stand(rows: DataFrame, checkpoint: str, epoch: int) -> None:
    """Write the standing rows that ``epoch`` brings, what they change by day, and its run."""
    spark, own = rows.sparkSession, f"{checkpoint.rstrip('/')}-runs/epoch={epoch}"
    if epoch:  # the epoch before this one has ended
        gone = [_run(checkpoint, e) for e in merged_runs(epoch - 1)]
        for path in [*gone, *([f"{checkpoint.rstrip('/')}-runs/epoch={epoch - 1}"] if covered(epoch - 1) > 1 else [])]:
            remove_path(spark, path)
    new = rows.select(*PK_COLUMNS, F.struct(*RANK).alias("row"))
    read = lambda paths: spark.read.schema(new.schema).parquet(*paths)
    there = lambda epochs: [x for x in (_run(checkpoint, e) for e in epochs) if path_exists(spark, x)]
    every = new.withColumn("old", F.lit(False))  # of this epoch
    if before := there(live_runs(epoch - 1)):
        first, last = new.agg(*(f("order_date").cast("string") for f in (F.min, F.max))).first()
        within = F.col("order_date").between(*(F.lit(x).cast("timestamp_ntz") for x in (first, last)))
        every = every.unionByName(read(before).where(within).withColumn("old", F.lit(True)))
    best = (every.repartition(*(F.col(c) for c in PK_COLUMNS)).groupBy(*PK_COLUMNS)  # no combining before: few keys repeat
            .agg(F.max("row").alias("row"), F.max(F.when(F.col("old"), F.col("row"))).alias("was")))
    stands = (best.where(F.col("was").isNull() | (F.col("row") > F.col("was")))
              .select(*PK_COLUMNS, "row", F.col("was.payment_value").alias("before"), F.col("was").isNull().alias("first")))
    stands.sortWithinPartitions("order_date").write.mode("overwrite").parquet(own)
    stands = spark.read.schema(stands.schema).parquet(own)
    (stands.groupBy(day("order_date").alias("date"))
     .agg(F.sum(F.col("first").cast("long")).alias("rows"), F.sum(F.col("row.payment_value") - F.coalesce("before", F.lit(0))).alias("cents"))
     .write.mode("overwrite").parquet(f"{_log(checkpoint)}/epoch={epoch}"))
    if covered(epoch) > 1:
        (read([own, *there(merged_runs(epoch))]).repartition(*(F.col(c) for c in PK_COLUMNS)).groupBy(*PK_COLUMNS).agg(F.max("row").alias("row"))
         .sortWithinPartitions("order_date").write.mode("overwrite").parquet(_run(checkpoint, epoch)))


def kpi_stream(spark: SparkSession, batch_dir: str, checkpoint: str, files_per_trigger: int = 1,
               available_now: bool = True) -> StreamingQuery:
    """Start the stream; its changes by day go to the log beside the checkpoint."""
    def run(df: DataFrame, epoch: int) -> None:
        with shuffles_dropped(df.sparkSession):
            stand(df, checkpoint, epoch)

    writer = (change_stream(spark, batch_dir, files_per_trigger).writeStream
              .foreachBatch(run).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def changes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(date, rows, cents) now: the sums of all changes so far."""
    if not path_exists(spark, _log(checkpoint)):
        return spark.createDataFrame([], CHANGES)
    every = spark.read.schema(CHANGES).parquet(f"{_log(checkpoint)}/epoch=*")
    return every.groupBy("date").agg(F.sum("rows").alias("rows"), F.sum("cents").alias("cents"))


def live_metrics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A3."""
    return changes(spark, checkpoint).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_orders"),
        (F.coalesce(F.sum("cents"), F.lit(0)).cast("decimal(38,2)") / 100).cast("double").alias("total_revenue"))


def live_daily(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A4, A5 and W1 by day: (date, total_revenue, order_count, cumulative_orders)."""
    by_day = changes(spark, checkpoint).select(
        "date", (F.col("cents").cast("decimal(38,2)") / 100).cast("double").alias("total_revenue"), F.col("rows").alias("order_count"))
    return by_day.join(growth_of(by_day.select("date", "order_count")), "date")
