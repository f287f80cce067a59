"""Operator 3 — repeated runs of lines, found by winnowing. DataFrame operations only.

The lines with a word are hashed; of each ``window`` consecutive ones the least
hash (the last, if equal) is selected as the fingerprint. Two equal runs of
``window`` lines or more select the same lines, so that every repeated run is
bound to be met at a selected line. Positions of selected lines are joined on
their hashes; around each that occurs more than once, the match is extended
both ways: all windows that selected it are compared by digest, and a window
that stands earlier in the corpus is repeated here. Windows that overlap or
touch make up one run. The lines of later runs are deleted; the first
occurrence in the order (doc_id, place) stays.

So a line goes exactly if it lies in ``window`` consecutive lines that stand
earlier. A document of fewer lines is one window of all its lines. Lines
without a word don't count; within a run they go with it. With ``words`` given,
there is a second kind of window, that closes as soon as it has so many words:
lines of fewer than ``window``, down to a single long one, go as well if they
have that many words and stand earlier.

A line that a third of all rows share makes no pairs: each group of equal
windows is reduced to its earliest place before the join.

Cases: null and empty texts have no lines and stay as they are; a null doc_id
comes first; rows alike in doc_id and text are one document (they keep and lose
the same lines), rows with the same doc_id and other texts are told apart by
their text; an empty table gives no rows; all columns of the input stay, the
operator's own begin with ``run_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import boxed, n_words, unboxed, written

WINDOW = 3


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _windows(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """A row for each selected line: run_id, run_text, anchor, windows (a, b, digest)."""
    at = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(_has_word(x), F.struct(F.xxhash64(x).alias("h"), (-i).alias("i"),
                                                                                      *([n_words(x).alias("n")] if words else []))))
    lines = docs.select(F.col("doc_id").alias("run_id"), F.xxhash64("text").alias("run_text"),
                        F.filter(at, lambda x: x.isNotNull()).alias("lines")).filter(F.size("lines") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines") - (window - 1)))

    def whole(i: Column) -> Column:
        return one(F.slice("lines", i, window))

    def one(part: Column) -> Column:
        return F.struct(F.array_min(part).alias("least"),
                        F.struct((-F.element_at(part, 1)["i"]).alias("a"), (-F.element_at(part, -1)["i"]).alias("b"),
                                 F.xxhash64(F.transform(part, lambda x: x["h"])).alias("digest")).alias("w"))

    def short(i: Column) -> Column:
        """The window from line ``i`` on that closes at ``words`` words before ``window`` lines, or null."""
        closed = F.lit(None)
        for k in range(window - 1, 0, -1):
            part = F.slice("lines", i, k)
            enough = (F.size(part) == k) & (F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n + x["n"]) >= words)
            closed = F.when(enough, one(part)).otherwise(closed)
        return closed

    found = F.transform(starts, whole)
    if words:
        found = F.concat(found, F.filter(F.transform(F.sequence(F.lit(1), F.size("lines")), short), lambda x: x.isNotNull()))
    return (lines.select("run_id", "run_text", F.explode(found).alias("x"))
            .select("run_id", "run_text", F.col("x.least.h").alias("anchor"), (-F.col("x.least.i")).alias("place"),
                    F.col("x.w.a").alias("a"), F.col("x.w.b").alias("b"), F.col("x.w.digest").alias("digest")))


def _grown(done: Column, x: Column) -> Column:
    """``done`` runs with window ``x`` after them: it lengthens the last or begins another."""
    last = F.try_element_at(done, F.lit(-1))
    longer = F.concat(F.slice(done, 1, F.size(done) - 1),
                      F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
    return F.when(x["a"] <= last["b"] + 1, longer).otherwise(F.concat(done, F.array(x)))


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(run_id, run_text, runs): line numbers a to b of each later repeated run of a document."""
    found = written(_windows(docs, window, words), "line_windows")
    # selected places whose line is selected anywhere else: a place counts once, however many windows chose it
    several = (found.groupBy("anchor").agg(F.min(F.struct("run_id", "run_text", "place")).alias("p"),
                                           F.max(F.struct("run_id", "run_text", "place")).alias("q"))
               .filter("p <> q").select("anchor"))
    matched = found.join(written(several, "line_anchors"), "anchor", "left_semi")
    place = F.struct("run_id", "run_text", "a")
    first = written(matched.groupBy("anchor", "digest").agg(F.min(place).alias("p"), F.max(place).alias("q"))
                    .filter("p <> q").select("anchor", "digest", "p"), "line_first")
    later = matched.join(first, ["anchor", "digest"]).filter(place != F.col("p"))
    windows = later.groupBy("run_id", "run_text").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("w"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return windows.select("run_id", "run_text", F.aggregate("w", none, _grown).alias("runs"))


def drop_repeated_runs(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``.

    Adds run_lines (lines before), run_removed (lines deleted, those without a
    word included) and the runs' places run_places (null: none); they replace
    columns of these names.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), window, words)
    rows = boxed(docs, id=F.col("doc_id"), key=F.xxhash64("text"), text=F.col("text"))
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("key") == F.col("run_text")), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["a"]) & (i <= r["b"])))
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1)
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return unboxed(joined, docs.columns, text=text, run_lines=F.coalesce(F.size(lines), F.lit(0)).cast("long"),
                   run_removed=F.coalesce(gone, F.lit(0)).cast("long"), run_places=F.col("runs"))
