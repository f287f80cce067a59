"""The end-to-end local run: clean, check, cut, check, load, check, train.

The pointer names the next batch to load (``streaming.loader``). A dry run
counts that batch and writes nothing to the table; a real run loads every
pending batch, validates the table and retrains the model. Batches that were
cut before and still fit the clean table are kept, so a second run finds
nothing new ("up to date"); otherwise the old cut goes and the pointer
starts anew with the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators import validate as V
from shoplens.operators.clean import build_orders_clean
from shoplens.schema import CLEAN_COLUMNS, DEFAULT_BATCH_SIZE
from shoplens.session import path_exists
from shoplens.sources import batches as B
from shoplens.sources.clean_store import read_clean
from shoplens.streaming.loader import ingest, next_batch, refresh_after_batch

MODES = ("row", "daily")


RUN_SCHEMA = "run string, size int"  # of the current cut: its checkpoint, its batch size (null: daily)


def _cut_fits(spark: SparkSession, batch_dir: str, run_file: str, clean: DataFrame, batch_size: int | None) -> bool:
    if not path_exists(spark, f"{batch_dir}/_SUCCESS") or not path_exists(spark, f"{run_file}/_SUCCESS"):
        return False
    if spark.read.schema(RUN_SCHEMA).json(run_file).first().size != batch_size:
        return False
    cut = B.read_batches(spark, batch_dir)
    if not V.check_batches(cut, clean, batch_size).first().passed:
        return False
    # the same rows, whatever their order: equal sums of row hashes (and counts, checked above)
    digest = F.sum(F.xxhash64(*CLEAN_COLUMNS).cast("decimal(38,0)"))
    return cut.agg(digest).first()[0] == clean.agg(digest).first()[0]


def run_ingest(spark: SparkSession, raw: dict[str, DataFrame], work: str, dry_run: bool = True,
               batch_size: int = DEFAULT_BATCH_SIZE, mode: str = "row", retrain: bool = True,
               marts: bool = False) -> dict:
    """Run the whole ingest under ``work`` (clean/, batches/, table/, checkpoint/, model/, marts/)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    work = work.rstrip("/")
    clean_path, batch_dir = f"{work}/clean", f"{work}/batches"
    table, run_file = f"{work}/table", f"{work}/checkpoint"

    translations = V.raise_if_failed(V.check_translations(raw["translations"]), "translation table")
    checked = V.write_checked(build_orders_clean(raw), clean_path)
    summary = {"translations": translations, "clean": V.raise_if_failed(checked, "clean table")}
    clean = read_clean(spark, clean_path, keep_partition=False)

    size = batch_size if mode == "row" else None
    if not _cut_fits(spark, batch_dir, run_file, clean, size):
        B.write_batches(B.split_row_batches(clean, batch_size) if mode == "row" else B.split_daily_batches(clean), batch_dir)
        # a new cut has a new checkpoint: pointers into the old one mean nothing now
        spark.createDataFrame([(uuid.uuid4().hex, size)], RUN_SCHEMA).coalesce(1).write.mode("overwrite").json(run_file)
    summary["batches"] = V.raise_if_failed(V.check_batches(B.read_batches(spark, batch_dir), clean, size), "batch")
    ckpt = f"{run_file}-{spark.read.schema(RUN_SCHEMA).json(run_file).first().run}"

    pointer = next_batch(spark, batch_dir, ckpt)
    summary["pointer"] = pointer
    summary["status"] = "up to date" if pointer == summary["batches"]["total_batches"] else "pending"
    if dry_run:
        pending = summary["status"] == "pending"
        summary["dry_run_rows"] = B.load_batch(spark, batch_dir, pointer, dry_run=True) if pending else 0
        return summary

    refresh = refresh_after_batch(marts_dir=f"{work}/marts" if marts else None, model_dir=f"{work}/model" if retrain else None)
    summary["pointer"] = ingest(spark, batch_dir, table, ckpt, on_compact=refresh)
    summary["table"] = V.check_table(read_clean(spark, table)).first().asDict()
    if retrain:
        from shoplens.plans.forecast import load_metrics
        summary["model"] = load_metrics(spark, f"{work}/model").first().asDict()
    return summary
