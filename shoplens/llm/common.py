"""Small helpers of the subpackage: tables, scratch folders, hash partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import remove_path, work_dir

#: Words are runs of characters other than these six: space and U+0009-U+000D.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared work folder and read it back.

    It cuts the lineage: a later loss of an executor re-reads files instead of
    redoing the work, and rows whose order Spark may choose are fixed.
    """
    path = f"{work_dir(df.sparkSession, name)}/table"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.written_at = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` made. Only those may go whose last reader has
    itself been written: a lost executor then re-reads that one, not these."""
    for t in tables:
        remove_path(t.sparkSession, t.written_at)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0): places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, and ``more`` columns made from its
    columns: no name of the input can clash with one that an operator uses."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in more.items()))


def unboxed(df: DataFrame, own: list[str], **more: Column) -> DataFrame:
    """The columns ``own`` of the box, those in ``more`` replaced, other ones of ``more`` added."""
    def picked(c: str) -> Column:
        return more[c].alias(c) if c in more else F.col("row").getField(c).alias(c)

    return df.select(*map(picked, own), *(v.alias(c) for c, v in more.items() if c not in own))
