"""Streamed KPIs equal those of the table, whatever the order of the batches."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from shoplens.operators import marts as M
from shoplens.session import work_dir
from shoplens.sources.clean_store import read_clean
from shoplens.sources.upsert import upsert
from shoplens.streaming import kpis as K
from tests.frames import clean_frame, left_after, row, shuffle_files


def put(df, batch_dir, batch, name):
    (df.withColumn("batch_id", F.lit(batch)).withColumn("batch_range", F.lit(name)).coalesce(1)
     .write.mode("append").partitionBy("batch_range").parquet(batch_dir))


def batches(spark, seed):
    rnd = random.Random(seed)
    return [clean_frame(spark, [row(f"o{rnd.randrange(25)}", "c", f"p{rnd.randrange(2)}", f"2024-01-0{1 + rnd.randrange(3)}", round(rnd.random() * 99, 2))
                                for _ in range(30)]) for _ in range(4)]


def same_as_table(spark, ckpt, cut):
    """The KPIs of the table that the upsert makes of the same batches."""
    target, every = work_dir(spark, "t-live-target"), None
    for k, df in cut.items():
        df = df.withColumn("batch_id", F.lit(k))
        every = df if every is None else every.unionByName(df)
    upsert(spark, target, every, order_col="batch_id")
    oc = read_clean(spark, target)
    assert K.live_metrics(spark, ckpt).collect() == M.metrics(oc).collect()
    daily = K.live_daily(spark, ckpt)
    assert daily.select("date", "total_revenue").orderBy("date").collect() == M.daily_revenue(oc).collect()
    assert daily.select("date", "order_count").orderBy("date").collect() == M.daily_orders(oc).collect()
    assert daily.select("date", "cumulative_orders").orderBy("date").collect() == M.data_growth(oc).collect()


@pytest.mark.parametrize("order,files", [((0, 1, 2, 3), 1), ((3, 0, 2, 1), 1), ((2, 3, 1, 0), 10)])
def test_any_order_of_batches(spark, order, files):
    batch_dir, ckpt, cut = work_dir(spark, "t-live"), work_dir(spark, "t-live-ckpt"), batches(spark, files)
    for k in order[:2]:
        put(cut[k], batch_dir, k, k)
    K.kpi_stream(spark, batch_dir, ckpt, files).awaitTermination()
    same_as_table(spark, ckpt, {k: cut[k] for k in order[:2]})
    for k in order[2:]:  # restart from the checkpoint
        put(cut[k], batch_dir, k, k)
    K.kpi_stream(spark, batch_dir, ckpt, files).awaitTermination()
    same_as_table(spark, ckpt, dict(enumerate(cut)))
    K.kpi_stream(spark, batch_dir, ckpt, files).awaitTermination()  # nothing new
    same_as_table(spark, ckpt, dict(enumerate(cut)))


def test_dies_after_its_changes_are_written(spark, monkeypatch):
    """An epoch that is run again overwrites its own changes."""
    batch_dir, ckpt, cut = work_dir(spark, "t-live-die"), work_dir(spark, "t-live-die-ckpt"), batches(spark, 8)
    for k in (0, 1):
        put(cut[k], batch_dir, k, k)
    stream = K.change_stream(spark, batch_dir)

    def die(df, epoch):
        (df.groupBy("date").agg(F.sum("rows").alias("rows"), F.sum("cents").alias("cents"))
         .write.mode("overwrite").parquet(f"{K._log(ckpt)}/epoch={epoch}"))
        raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        (stream.writeStream.outputMode("update").foreachBatch(die).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start().awaitTermination())
    K.kpi_stream(spark, batch_dir, ckpt).awaitTermination()
    same_as_table(spark, ckpt, {0: cut[0], 1: cut[1]})


def test_nothing_yet(spark):
    r = K.live_metrics(spark, work_dir(spark, "t-live-none")).first()
    assert r.total_orders == 0 and r.total_revenue == 0.0


def test_runs_are_merged_and_cover_all_epochs(spark):
    """More epochs than are merged into one run: no key is lost or counted twice, few runs are left, no key calls Python."""
    batch_dir, ckpt = work_dir(spark, "t-live-runs"), work_dir(spark, "t-live-runs-ckpt")
    cut = {k: df for k, df in enumerate(batches(spark, 3) + batches(spark, 4) + batches(spark, 5))}
    for k in sorted(cut, key=lambda k: k * 5 % 12):  # file by file, in an order of its own
        put(cut[k], batch_dir, k, k)
    K.kpi_stream(spark, batch_dir, ckpt).awaitTermination()
    same_as_table(spark, ckpt, cut)
    for n in range(1, 600):
        held = sum((list(range(e - K.covered(e) + 1, e + 1)) for e in K.live_runs(n)), [])
        assert sorted(held) == list(range(n + 1)) and len(K.live_runs(n)) <= 4 * K.MERGE
    found = os.listdir(f"{ckpt.removeprefix('file:')}-runs")
    assert {x for x in found if not x.startswith(".")} == {"merged=7", "epoch=8", "epoch=9", "epoch=10", "epoch=11"}
    import inspect
    assert "applyInPandas" not in inspect.getsource(K)


def test_rows_of_a_key_that_differ_late_or_early(spark):
    """One batch holds a key several times; which row stands is settled before the columns that the KPIs don't read."""
    rows = [row("o1", "c1", "p", "2024-01-01", 5, city="a"), row("o1", "c1", "p", "2024-01-01", 5, city="z"),
            row("o1", "c2", "p", "2024-01-01", 3), row("o2", "c", "p", "2024-01-01", 9, price="1.00"),
            row("o2", "c", "p", "2024-01-01", 2, price="2.00"), row("o3", "c", "p", "2024-01-02", 4, review=1), row("o3", "c", "p", "2024-01-02", 8, review=0)]
    batch_dir, ckpt = work_dir(spark, "t-live-ties"), work_dir(spark, "t-live-ties-ckpt")
    cut = {1: clean_frame(spark, rows), 0: clean_frame(spark, rows[::2]), 2: clean_frame(spark, rows[1:3])}
    for k in cut:
        put(cut[k], batch_dir, k, k)
        K.kpi_stream(spark, batch_dir, ckpt).awaitTermination()
        same_as_table(spark, ckpt, {j: cut[j] for j in list(cut)[:list(cut).index(k) + 1]})


def test_epochs_leave_only_narrow_rows(spark):
    """Shuffle files of an epoch go with it; the standing rows hold no column that no KPI depends on."""
    batch_dir, ckpt, cut = work_dir(spark, "t-live-disk"), work_dir(spark, "t-live-disk-ckpt"), batches(spark, 6)
    for k in range(4):
        put(cut[k], batch_dir, k, k)
    before = shuffle_files(spark)
    K.kpi_stream(spark, batch_dir, ckpt).awaitTermination()
    assert not left_after(spark, before)
    held = spark.read.parquet(f"{ckpt}-runs/epoch=3").select("row.*").columns
    assert held == ["batch_id", "customer_id", "price", "freight_value", "payment_value"]
