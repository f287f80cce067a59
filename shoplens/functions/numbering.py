"""Distributed global row numbering and exact percentiles.

A plain ``row_number() OVER (ORDER BY ...)`` without PARTITION BY moves every
row into one task. Instead:

1. ``orderBy`` range-partitions and sorts (partition bounds come from a
   sample, so partitions are balanced even for a skewed sort key);
2. ``monotonically_increasing_id`` packs (partition id, position within the
   partition) into one long;
3. a per-partition count (one row per partition) gives each partition its
   starting offset; that table is bounded by the partition count, so
   broadcasting it is safe.

The tagged rows are written once as Parquet (into the shared
``spark.checkpoint.dir``) before they are counted and numbered: the
count pass and the numbering pass must see the very same partitions, and
two separately planned range shuffles need not coalesce alike under AQE
(column pruning changes their sizes). The files also survive the loss of an executor,
and the count reads one column of them.

Callers should pass a *total* order (add key tie-breakers) so the numbers
themselves are reproducible from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | record index


def global_row_number(df: DataFrame, order_cols: list, name: str = "row_number") -> DataFrame:
    """Append a 1-based global position column following ``order_cols``."""
    from shoplens.session import materialize

    tagged = materialize(df.orderBy(*order_cols)
                         .withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_pid", F.shiftright(F.col("_mid"), _LOW_BITS))
                         .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1))
                         .drop("_mid"), "numbered")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # rows = number of partitions, bounded by configuration
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    numbered = (tagged.join(F.broadcast(offsets), "_pid")
                .withColumn(name, F.col("_offset") + F.col("_local") + 1)
                .drop("_pid", "_local", "_offset"))
    numbered.written_at = tagged.written_at
    return numbered


def exact_percentiles(df: DataFrame, value: str | Column, fractions: dict[str, float]) -> DataFrame:
    """One row with the exact linear-interpolated percentile of ``value``
    for each ``{alias: fraction}`` (``percentile_cont`` semantics).

    Only the values at the (at most two per fraction) needed ranks reach the
    final aggregate; the data itself is sorted in a distributed way.
    NULL values are ignored; empty input gives NULLs.
    """
    v = F.col(value) if isinstance(value, str) else value
    # the row hash breaks ties: a value shared by a third of all rows can
    # still be range-partitioned over many tasks
    vals = (df.select(v.cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_tie"))
            .where(F.col("_v").isNotNull()))
    n = vals.agg(F.count(F.lit(1)).alias("_cnt"))  # exactly one row
    numbered = global_row_number(vals, ["_v", "_tie"], "_rn").crossJoin(F.broadcast(n))
    aggs = []
    wanted = F.lit(False)
    for alias, p in fractions.items():
        pos = F.lit(float(p)) * (F.col("_cnt") - 1)
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        wanted = wanted | (F.col("_rn") == lo) | (F.col("_rn") == hi)
    picked = numbered.where(wanted)
    for alias, p in fractions.items():
        pos = F.lit(float(p)) * (F.col("_cnt") - 1)
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        v_lo = F.max(F.when(F.col("_rn") == lo, F.col("_v")))
        v_hi = F.max(F.when(F.col("_rn") == hi, F.col("_v")))
        frac = F.max(pos - F.floor(pos))
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(alias))
    out = picked.agg(*aggs)
    return out
