"""Operator 10 — best-fit packing of documents into fixed-length sequences.

Hierarchical residual packing: each partition cuts its documents into pieces
and packs them best-fit (longest first); full or nearly full bins are final.
Underfull bins then become items: groups of partitions merge them best-fit,
round after round up a tree of ``FAN`` groups, until one group is left.

Nothing unbounded climbs the tree. After best-fit any two bins of a group
exceed the capacity together, so at most one of them is half empty or more
(the *seeker*); only seekers can still be joined with anything. A group hands
up its seekers and, for ``s`` seekers in the whole table (at most one a
partition), its ``s`` emptiest other bins: a seeker takes one host, so no
group can lose more. All other bins are final where they are.

The full table of pieces is written once and joined once with the moves (one
row a moved bin).

Cases: null texts are empty documents (their end id only); null or repeated
doc_ids are packed row by row; texts of any length are cut into whole pieces
of ``capacity`` ids, the first piece shorter; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import written
from shoplens.llm.tokens import encoded, encoder

FAN = 8

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "part int, bin long, offset long, bin_size long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit, longest first. Returns each item's bin and offset, and the bins' sizes.

    Bins are found by their free space: ``by_free[f]`` lists those with ``f``
    left, ``frees`` the values of ``f`` that occur, in order.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    where, offset, filled = [0] * len(sizes), [0] * len(sizes), []
    by_free: dict[int, list[int]] = {}
    frees: list[int] = []
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(frees, s)
        if k < len(frees):
            free = frees[k]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[k]
        else:
            b, free = len(filled), capacity
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += s
        left = free - s
        if left:
            if left not in by_free:
                by_free[left] = []
                bisect.insort(frees, left)
            by_free[left].append(b)
    return where, offset, filled


def _pieces(tokenizer: str, kind: str, end_id: int, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        cols: list[list] = [[], [], [], [], []]
        for b in batches:
            for doc_id, own in zip(b.column(0).to_pylist(), encoded(enc, b.column(1))):
                ids = own + end
                n = len(ids) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cut, cut[1:])):
                    for col, v in zip(cols, (doc_id, k, s, e - s, zlib.crc32(ids[4 * s:4 * e]))):
                        col.append(v)
        where, offset, filled = best_fit(cols[3], capacity)
        n = len(where)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(cols, types)), pa.array([part] * n, pa.int32()),
             pa.array(where, pa.int64()), pa.array(offset, pa.int64()),
             pa.array([filled[b] for b in where], pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "bin_size"])

    return run


def _merge(capacity: int, hosts: int):
    """One round over a group: best-fit over underfull bins as items."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["size", "part", "bin"], ascending=[False, True, True], ignore_index=True)
        where, offset, filled = best_fit(pdf["size"].tolist(), capacity)
        first: dict[int, int] = {}
        for i, b in enumerate(where):  # the first item in a bin names it
            if offset[i] == 0:
                first[b] = i
        rows = pd.DataFrame({"part": pdf["part"], "bin": pdf["bin"],
                             "to_part": [pdf["part"][first[b]] for b in where],
                             "to_bin": [pdf["bin"][first[b]] for b in where],
                             "shift": offset, "size": [filled[b] for b in where]})
        top = rows[rows["shift"] == 0].sort_values(["size", "part", "bin"])
        seeks = top["size"] * 2 <= capacity
        up = pd.concat([top[seeks], top[~seeks].head(hosts)]).index
        rows["up"] = rows.index.isin(up)
        rows["group"] = key[0]
        return rows[["part", "bin", "to_part", "to_bin", "shift", "size", "up", "group"]]

    return run


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2,
                   capacity: int = 1024, full: float = 0.999) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and place of each.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Bins filled to ``full`` of the capacity take no part in the merging.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = written(rows.mapInArrow(_pieces(tokenizer, kind, end_id, capacity), PIECES), "packing")

    bins = (local.filter((F.col("offset") == 0) & (F.col("bin_size") <= full * capacity))
            .select("part", "bin", F.col("bin_size").alias("size")))
    by_part = (local.filter(F.col("offset") == 0).groupBy("part")
               .agg(F.sum((F.col("bin_size") * 2 <= capacity).cast("long")).alias("seekers")))
    seekers, last = by_part.agg(F.sum("seekers"), F.max("part")).first()
    seekers, groups = seekers or 0, (last or 0) + 1
    if not seekers:
        moves = None
    else:
        # all seekers, and the emptiest hosts of each partition
        seek = F.col("size") * 2 <= capacity
        rank = F.row_number().over(W.partitionBy("part", seek).orderBy("size", "bin"))
        live = (bins.withColumn("rank", rank).filter(seek | (F.col("rank") <= seekers))
                .withColumn("group", F.col("part").cast("long")).drop("rank"))
        live, moves = written(live, "packing_up"), None
        while groups > 1:
            groups = -(-groups // FAN)
            step = written(
                live.withColumn("group", F.floor(F.col("group") / FAN)).groupBy("group")
                .applyInPandas(_merge(capacity, seekers), "part int, bin long, to_part int, to_bin long, "
                               "shift long, size long, up boolean, group long"), "packing_merge")
            moved = step.filter("part <> to_part OR bin <> to_bin").select("part", "bin", "to_part", "to_bin", "shift")
            if moves is None:
                moves = moved
            else:
                on = moved.select(F.col("part").alias("to_part"), F.col("bin").alias("to_bin"),
                                  F.col("to_part").alias("p2"), F.col("to_bin").alias("b2"), F.col("shift").alias("s2"))
                moves = moves.join(on, ["to_part", "to_bin"], "left").select(
                    "part", "bin", F.coalesce("p2", "to_part").alias("to_part"), F.coalesce("b2", "to_bin").alias("to_bin"),
                    (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift")).unionByName(moved)
            live = step.filter("up").select("part", "bin", "size", "group")
    out = local
    if moves is not None:
        out = out.join(moves, ["part", "bin"], "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("to_part", "part").alias("part"), F.coalesce("to_bin", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    # a bin number is below the pieces of one task; 2^36 of them leave room for 2^27 partitions
    return out.select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("part").cast("long") * F.lit(1 << 36) + F.col("bin")).alias("sequence_id"), "offset")
