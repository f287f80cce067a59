"""Operator 5 — mixing sources to target weights by weighted fair queueing.

DataFrame operations only. Each source is a queue of its documents in a fixed
shuffled order (MD5 of the id); the queue is served again from its head when it
runs out, at most ``max_passes`` times. A document's virtual finish time is the
number of its source's words up to its end, divided by the source's target.
The mixture is put in order of virtual time by a global range sort and ends
where the total budget is spent: as the targets add up to the budget, that is
at virtual time 1. The document in service at that moment is cut there, so that
every source gets its target to the word.

No task holds a source: a queue is cut by leading digits of the MD5 into
buckets of about ``bucket_rows`` rows of all rows; their sums are added up per
source before a document's place in its bucket is looked up.

Cases: a null text has size 0; a null source is a source of its own, last in
order; null and repeated doc_ids are served row by row; a source without words
has target 0; an empty table gives no rows; columns of the input are kept as
they are, but for those whose names the added ``mix_`` columns have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import boxed, shuffle_partitions, unboxed, written

WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget_share: float = 1.0, max_passes: int = 3) -> DataFrame:
    """Targets of sources, from rows (mix_null, mix_source, source_size).

    Sources in order of code points (null last) take ``weights`` in turn. A
    target above ``max_passes`` times its source's size stops there, and what
    is over goes to the others by weight, until none is above. With the sources
    sorted by size a weight, the stopped ones come first, so one pass over the
    sorted table (a row a source) finds them all.
    """
    by_name = W.orderBy("mix_null", "mix_source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "mix_null", "mix_source")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    limit = F.lit(max_passes) * F.col("source_size")
    rest = F.lit(budget_share) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    share = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = weighted.withColumn("level", share).withColumn("fits", F.col("weight") * F.col("level") <= limit)
    # levels fall from the first source that isn't stopped on: the highest is its level, and that of all later ones
    level = F.max(F.when(F.col("fits"), F.col("level"))).over(every)
    target = F.least(F.coalesce(F.col("weight") * level, limit.cast("double")), limit.cast("double"))
    return found.select("mix_null", "mix_source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple = WEIGHTS, budget_share: float = 1.0, max_passes: int = 3,
        bucket_rows: int = 20_000) -> DataFrame:
    """The mixture of ``docs`` (doc_id, source, ...), in order of virtual time.

    Returns the columns of ``docs`` and, for each pass over each document:
    mix_size, mix_source_size, mix_target, mix_row (its number within
    mix_bucket of its source), mix_copy (from 0), mix_finish and mix_taken, the
    words the mixture takes of it (0: it comes after the end).
    """
    digits = max(1, math.ceil(math.log(max(1, docs.count() / bucket_rows), 16)))
    rows = boxed(
        docs, id=F.col("doc_id"), mix_size=size.cast("long"), mix_null=F.col("source").isNull(),
        mix_source=F.coalesce(F.col("source").cast("string"), F.lit("")),
        mix_hash=F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("mix_bucket", F.substring("mix_hash", 1, digits))
    source = ["mix_null", "mix_source"]
    sums = written(rows.groupBy(*source, "mix_bucket").agg(F.sum("mix_size").alias("words")), "mix_sums")
    goals = targets(sums.groupBy(*source).agg(F.sum("words").alias("source_size")), weights, budget_share, max_passes)
    ahead = W.partitionBy(*source).orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    places = (sums.withColumn("mix_ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
              .join(goals, source).withColumnsRenamed({"source_size": "mix_source_size", "target": "mix_target"}))

    queue = W.partitionBy(*source, "mix_bucket").orderBy("mix_hash", "id", "mix_size")
    queued = (rows
              .withColumn("mix_row", F.row_number().over(queue))
              .withColumn("mix_in", F.sum("mix_size").over(queue.rowsBetween(W.unboundedPreceding, 0)) - F.col("mix_size"))
              .join(places, [*source, "mix_bucket"]))
    passes = F.greatest(F.lit(1), F.ceil(F.col("mix_target") / F.greatest(F.col("mix_source_size"), F.lit(1)))).cast("int")
    served = queued.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    start = F.col("mix_copy") * F.col("mix_source_size") + F.col("mix_ahead") + F.col("mix_in")
    finish = F.coalesce(F.try_divide((start + F.col("mix_size")).cast("double"), F.col("mix_target")), F.lit(0.0))
    taken = F.least(F.col("mix_size"), F.greatest(F.lit(0), F.floor("mix_target") - start))
    n = shuffle_partitions(docs.sparkSession)
    ordered = (served.withColumn("mix_finish", finish).withColumn("mix_taken", taken.cast("long"))
               .repartitionByRange(n, "mix_finish", "id").sortWithinPartitions("mix_finish", "id", "mix_copy"))
    added = ("mix_size", "mix_source_size", "mix_target", "mix_bucket", "mix_row", "mix_copy", "mix_finish", "mix_taken")
    return unboxed(ordered, docs.columns, **{c: F.col(c) for c in added})


def taken_text(text: Column, taken: Column, size: Column) -> Column:
    """``text``, or its first ``taken`` words with the white space before and
    between them if that is not all of it."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.when(taken >= size, text).otherwise(F.array_join(F.slice(words, 1, taken.cast("int")), ""))
