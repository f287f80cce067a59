"""Literal clean-fact frames for hand-computed cases."""

from __future__ import annotations

import datetime as dt
import time
from decimal import Decimal

from shoplens.schema import CLEAN_SCHEMA


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def row(order_id, customer_id, product_id, date, pay, cat="cat_a", state="S1", price="1.00", freight="0.00",
        review=3, city="c"):
    return (order_id, customer_id, product_id, ts(date), Decimal(price), Decimal(freight), Decimal(str(pay)),
            review, cat, city, state)


def clean_frame(spark, rows):
    return spark.createDataFrame(rows, CLEAN_SCHEMA)


def shuffle_files(spark):
    """The shuffle files that lie on this machine now."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("|").split("|") if "/shuffle_" in f}


def left_after(spark, before, seconds=10):
    """Shuffle files that were not there ``before``, after a while in which Spark may remove them."""
    for _ in range(10 * seconds):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left
