"""The training-data pipeline over ``documents``: from raw texts to packed sequences.

Each stage reads all rows that the one before kept, written as Parquet in
between; all but the last return the columns of ``documents``.

1. quality      — operator 9: documents scored under 0.3 go.
2. line_dedup   — operator 3: later repeated runs of lines are deleted; a
   document of which no word is left goes.
3. near_dedup   — operator 8 (five words, Jaccard 0.8): the document with the
   least id of each group stays (of equal ids the least text hash, a null id
   last); rows alike in doc_id and text count once.
4. mix          — operator 5: sources 1 : 2 : 3 in turn, the total size as
   budget; a document comes once for each time it is taken, and one that is in
   service when the budget ends keeps its first words.
5. pack         — operator 10: pieces in sequences of 1024 ids.

``n_chars`` follows a changed text. Nulls, empty tables and repeated rows are
treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.classifier import score, train
from shoplens.llm.common import boxed, n_words, table, unboxed, written
from shoplens.llm.line_runs import drop_repeated_runs
from shoplens.llm.mixing import mix, taken_text
from shoplens.llm.near_dups import near_duplicates
from shoplens.llm.packing import pack_documents
from shoplens.llm.queries import END_ID, GOOD, tokenizer_path


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, n_chars counted anew."""
    length = F.length("text").cast("long")
    return df.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter(F.col("quality_score") >= GOOD).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = drop_repeated_runs(docs)
    return _columns(left.filter((F.col("run_removed") == 0) | (n_words(F.col("text")) > 0)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, 80, 100)
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("p"))
    kept = (least.select("p.doc_id", "p.key").union(found.filter("root IS NULL").select("doc_id", "key").distinct())
            .toDF("kept_id", "kept_key"))
    rows = boxed(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    stays = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    return unboxed(rows.join(kept, stays, "left_semi").dropDuplicates(["id", "key"]), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    passes = mix(docs, n_words(F.col("text"))).filter("mix_taken > 0")
    return _columns(passes.withColumn("text", taken_text(F.col("text"), F.col("mix_taken"), F.col("mix_size"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), "byte", END_ID, 1024)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack)]

#: No SQL twin: a fitted classifier, a tokenizer and best-fit can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
