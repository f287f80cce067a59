"""Operator 7 — repeated lines, paragraphs, sentences or clauses, removed with their offsets retained.

Texts are cut into units; a unit is normalised (lower case, white space as one
space) and digested. Digests are grouped over all documents; the occurrence with
the least rank (doc_id, then place) stays. Each removed unit is given by its
code point offsets in the original text, its line end or space included. Two rules:

* *units* (:func:`repeated_units`): every later occurrence of a unit of
  ``least_words`` words or more goes (128-bit digests).
* *runs* (:func:`repeated_runs`): units of any length are digested together with
  the unit behind them (and alone, if they reach ``run_words``), 64 bits each. Later
  occurrences of such pairs that follow each other without a gap are a run, and a
  run goes if its units hold ``run_words`` words together. A common short unit thus
  never goes by itself, and a passage goes wherever in a line it begins or ends, but
  for the words of its two cut-off end units. Units without a word are passed over.

Digests are counted first, and only those that occur twice are looked at with
their places. A unit that a third of all rows share is reduced to its
earliest place before the join.

Cases: null and empty texts have no units; a null doc_id comes first; rows
alike in doc_id and text are one document (units stay or go alike in them);
rows with the same doc_id and other texts are told apart; texts of any length
are read whole; an empty table gives no rows; all columns of the input stay,
the operator's own begin with ``unit_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.common import boxed, unboxed, written

#: ends of units
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\t\r]*\n\s*"),
          "sentence": re.compile(r"\n|(?<=[.!?])[\x20\t]+"), "clause": re.compile(r"\n|(?<=[.!?,;:])[\x20\t]+")}

_UNITS = "unit_id long, unit_text long, unit int, start int, stop int, digest binary"


def units(text: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, content) of each unit; stop is behind its break."""
    start = 0
    for m in BREAKS[kind].finditer(text):
        yield start, m.end(), text[start:m.start()]
        start = m.end()
    if start < len(text):
        yield start, len(text), text[start:]


def _digests(kind: str, least_words: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = ["unit_id", "unit_text", "unit", "start", "stop", "digest"]
        for b in batches:
            rows: list = []
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for k, (start, stop, content) in enumerate(units(text.as_py(), kind)):
                    words = content.lower().split()
                    if len(words) >= least_words:
                        rows.append((doc_id, key, k, start, stop, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8"))))
            cols = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _without(text: str, spans: list) -> str:
    """``text`` without ``spans``; the break before a removed end of the text goes with it."""
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at:start])
        at = stop
    out.append(text[at:])
    return "".join(out)


def _cleaned(place: int):
    """Column ``place`` is the text, the two last ones the removed starts and stops."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            starts, stops = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            texts = [t if s is None else pa.scalar(_without(t.as_py(), zip(s, e)), t.type)
                     for t, s, e in zip(b.column(place), starts, stops)]
            yield b.set_column(place, b.schema.field(place), pa.array([t.as_py() for t in texts], b.column(place).type))

    return run


def repeated_units(docs: DataFrame, kind: str = "line", least_words: int = 5) -> DataFrame:
    """(unit_id, unit_text, unit_starts, unit_stops): removed spans of each document that has any."""
    rows = docs.filter("text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    found = written(rows.mapInArrow(_digests(kind, least_words), _UNITS), "units")
    place = F.struct("unit_id", "unit_text", "unit")
    first = written(found.groupBy("digest").agg(F.min(place).alias("p"), F.max(place).alias("q"))
                    .filter("p <> q").select("digest", "p"), "units_first")
    later = found.join(first, "digest").filter(place != F.col("p"))
    spans = later.groupBy("unit_id", "unit_text").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    return spans.select("unit_id", "unit_text", F.col("s.start").alias("unit_starts"), F.col("s.stop").alias("unit_stops"))


def worded(text: str, kind: str) -> list[tuple[int, int, list[str]]]:
    """(start, stop, words) of the units that have a word."""
    found = ((start, stop, content.lower().split()) for start, stop, content in units(text, kind))
    return [u for u in found if u[2]]


def _pairs(kind: str, run_words: int):
    """Of each document the digests of neighbouring units, and of long units alone with their places."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            pairs, alone = [], []
            for text in b.column(2):
                own = worded(text.as_py(), kind)
                one = [xxhash.xxh3_64_intdigest(" ".join(w)) for _, _, w in own]
                h = np.array(one, np.uint64)
                both = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
                pairs.append(both.view(np.int64))
                alone.append([{"unit": k, "digest": int(h[k:k + 1].view(np.int64)[0])} for k, (_, _, w) in enumerate(own) if len(w) >= run_words])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pairs, pa.list_(pa.int64())),
                 pa.array(alone, pa.list_(pa.struct([("unit", pa.int32()), ("digest", pa.int64())])))],
                names=["unit_id", "unit_text", "pairs", "alone"])

    return run


def _spans(text: str, kind: str, pairs: set, alone: set, run_words: int) -> tuple[list[int], list[int]]:
    """Starts and stops of the units in runs of later occurrences of ``run_words`` words."""
    own, starts, stops, at = worded(text, kind), [], [], 0
    while at < len(own):
        last = at - 1  # the last unit of the run that begins here
        while last + 1 < len(own) and (last + 1 in alone or last + 1 in pairs or (last >= at and last in pairs)):
            last += 1
        if last >= at and sum(len(w) for _, _, w in own[at:last + 1]) >= run_words:
            starts += [u[0] for u in own[at:last + 1]]
            stops += [u[1] for u in own[at:last + 1]]
        at = max(last, at) + 1
    return starts, stops


def _run_spans(kind: str, run_words: int, place: int):
    """Column ``place`` is the text, the two last ones the places of later pairs and of
    later units alone; in their stead come the removed starts and stops."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, texts, starts, stops = b.num_columns - 2, [], [], []
            for text, pairs, alone in zip(b.column(place).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                s, e = _spans(text, kind, set(pairs or ()), set(alone or ()), run_words) if pairs or alone else ([], [])
                texts.append(_without(text, zip(s, e)) if s else text)
                starts.append(s or None)
                stops.append(e or None)
            kept = [pa.array(texts, b.column(k).type) if k == place else b.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))],
                names=[*b.schema.names[:n], "unit_starts", "unit_stops"])

    return run


def later_pairs(docs: DataFrame, kind: str, run_words: int) -> DataFrame:
    """(unit_id, unit_text, pairs, alone): of each document that has any, the places
    where a pair, or a long unit alone, stands that stands at a lower rank as well."""
    rows = docs.filter("text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    found = written(rows.mapInArrow(_pairs(kind, run_words),
                                    "unit_id long, unit_text long, pairs array<long>, alone array<struct<unit:int,digest:long>>"), "unit_pairs")
    # one number a place: a pair's unit, or minus one and less for a unit alone
    every = found.select("unit_id", "unit_text", F.posexplode("pairs").alias("place", "digest")).unionByName(
        found.select("unit_id", "unit_text", F.explode("alone").alias("a"))
        .select("unit_id", "unit_text", (-1 - F.col("a.unit")).alias("place"), F.col("a.digest").alias("digest")))
    kind_of = (F.col("place") < 0).alias("single")
    # both are written: a join of two plain tables can split a digest that is too frequent
    twice = written(every.select("digest", kind_of).groupBy("digest", "single").count().filter("count > 1")
                    .select("digest", "single"), "unit_twice")
    again = written(every.select("*", kind_of).join(twice, ["digest", "single"], "left_semi"), "unit_again")
    rank = F.struct("unit_id", "unit_text", F.abs("place").alias("at"))
    first = written(again.groupBy("digest", "single").agg(F.min(rank).alias("p")), "unit_first")
    later = again.join(first, ["digest", "single"]).filter(rank != F.col("p"))
    return later.groupBy("unit_id", "unit_text").agg(
        F.collect_set(F.when(~F.col("single"), F.col("place"))).alias("pairs"),
        F.collect_set(F.when(F.col("single"), -1 - F.col("place"))).alias("alone"))


def drop_repeated_runs_of_units(docs: DataFrame, kind: str = "clause", run_words: int = 40) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later runs of repeated units removed from
    ``text``; adds unit_starts and unit_stops as :func:`drop_repeated_units` does."""
    found = later_pairs(docs.select("doc_id", "text"), kind, run_words)
    own = [c for c in docs.columns if c not in ("unit_starts", "unit_stops")]
    rows = boxed(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("unit_id")) & (F.col("key") == F.col("unit_text")), "left")
    flat = joined.select(*(F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(own)),
                         "pairs", "alone")
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own))).schema
    schema = plain.add("unit_starts", T.ArrayType(T.IntegerType())).add("unit_stops", T.ArrayType(T.IntegerType()))
    out = flat.mapInArrow(_run_spans(kind, run_words, own.index("text")), schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(own)), "unit_starts", "unit_stops")


def drop_repeated_units(docs: DataFrame, kind: str = "line", least_words: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated units removed from ``text``;
    adds unit_starts and unit_stops, the removed offsets (null: none), which
    replace columns of these names."""
    spans = repeated_units(docs.select("doc_id", "text"), kind, least_words)
    rows = boxed(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("unit_id")) & (F.col("key") == F.col("unit_text")), "left")
    own = [c for c in docs.columns if c not in ("unit_starts", "unit_stops")]
    found = unboxed(joined, own, unit_starts=F.col("unit_starts"), unit_stops=F.col("unit_stops"))
    return found.mapInArrow(_cleaned(own.index("text")), found.schema)
