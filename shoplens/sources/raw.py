"""Read the seven headered raw CSV tables.

Every column is read as text (no schema inference: that would cost an extra
scan and is unstable across files); only the first line is read ahead, for the
columns' order. Quotes within a quoted field are doubled, and review texts may
hold line ends. The clean step coerces with ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplens.schema import RAW_FILES, RAW_REQUIRED_COLUMNS
from shoplens.session import path_exists

#: tables with free text: a quoted field may hold line ends, so a file is one split
FREE_TEXT = ("reviews",)


def resolve_raw_file(spark: SparkSession, filename: str, raw_dir: str,
                     fallback_dir: str | None = None) -> str:
    """The raw-data folder first, then the fallback folder; missing is an error."""
    for base in (raw_dir, fallback_dir):
        if base:
            path = f"{base.rstrip('/')}/{filename}"
            if path_exists(spark, path):
                return path
    raise FileNotFoundError(f"no {filename} in {raw_dir} or {fallback_dir}")


def read_raw(spark: SparkSession, raw_dir: str, fallback_dir: str | None = None,
             files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}
    for name, filename in (files or RAW_FILES).items():
        path = resolve_raw_file(spark, filename, raw_dir, fallback_dir)
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE").option("escape", '"')
              .option("multiLine", name in FREE_TEXT).csv(path))
        missing = [c for c in RAW_REQUIRED_COLUMNS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{filename} is missing columns: {missing}")
        tables[name] = df
    return tables
