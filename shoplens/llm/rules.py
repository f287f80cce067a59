"""Operator 4 — quality rules with host-level verdicts.

Per document, rules over the whole text; per host (``source``), the share of
documents that fail a rule, shrunk by a beta prior that is fitted to the
shares of all hosts (method of moments); hosts whose shrunken share is above
``host_limit`` are rejected, and their verdict is joined back to their
documents. A small host with two bad pages is thus judged mostly by what is
usual, a large one by its own figures.

Rules: the base rule (under 20 words, or over 30 % of the words in repeated
8-word windows), symbols (over one for every ten words) and repeated lines
(over 30 % of the lines with a word).

Cases: a null text has no words; a null source is a host of its own; null or
repeated doc_ids stay row by row; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import written

WINDOW = 8
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
#: odd multipliers, one for each place in a window
_MIX = (np.random.default_rng(4).integers(1, 1 << 62, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

STATS = ("doc_id long, source string, n_words long, word_chars long, n_symbols long, n_lines long, "
         "n_dup_lines long, n_repeat_words long")


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8")
    words = raw.split()
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeated = 0
    if n > WINDOW:
        seen: dict = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
        if len(seen) < n:  # without any word twice no window comes twice
            grams = np.zeros(n - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                grams += (ids[k:n - WINDOW + 1 + k] + np.uint64(1)) * _MIX[k]
            order = np.sort(grams)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                at = np.flatnonzero(np.isin(grams, twice))
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                repeated = int((np.cumsum(cover[:n]) > 0).sum())
    return n, len(text) - spaces, n_symbols, len(lines), len(lines) - len(set(lines)), repeated


def _stats(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = [text_stats(t.as_py() or "") for t in b.column(2)]
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols)],
            names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])


def host_verdicts(stats: DataFrame, host_limit: float) -> DataFrame:
    """(host_null, host, host_docs, host_failed, host_rate, host_ok), a row a host."""
    hosts = (stats.groupBy("host_null", "host")
             .agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
             .withColumn("rate", F.col("host_failed") / F.col("host_docs")))
    mean, spread = hosts.agg(F.avg("rate"), F.var_pop("rate")).first()
    if not spread:  # all hosts alike (or none): the prior outweighs any host
        rate = F.lit(mean or 0.0)
    else:
        strength = max(0.0, mean * (1 - mean) / spread - 1)
        rate = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return (hosts.withColumn("host_rate", rate.cast("double"))
            .select("host_null", "host", "host_docs", "host_failed", "host_rate",
                    (F.col("host_rate") <= host_limit).alias("host_ok")))


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Rule figures and verdicts of ``docs`` (doc_id, source, text), row by row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    failed = base | (F.col("n_symbols") * 10 > F.col("n_words")) | (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)
    stats = written(rows.mapInArrow(_stats, STATS), "rules").select(
        "*", base.alias("base_failed"), failed.alias("failed"),
        F.col("source").isNull().alias("host_null"), F.coalesce("source", F.lit("")).alias("host"))
    return (stats.join(host_verdicts(stats, host_limit), ["host_null", "host"])
            .withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_null", "host"))
