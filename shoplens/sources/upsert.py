"""Keyed upsert into the month-partitioned clean table, file by file.

Parquet has no MERGE. What is rewritten are the files that hold a key of the
batch, not the months they lie in:

1. the batch is written once and reduced to one row a key (the database would
   reject a batch that hits one key twice; we keep one and report it);
2. the batch's keys are looked up in the files of the touched months, as narrow rows
   (hashes of key, row and file): the files with a hit are the *old* files. New
   keys alone touch no file. Of a large batch one key in ``PROBE`` is looked up first, the
   others only where that leaves a file or month open. A month in which every row
   of the batch stands already (a replay) is left as it is. A month that has gathered more
   than ``SMALL_FILES`` small files has these rewritten along, so that appends don't pile up;
3. the rows of the old files whose key isn't in the batch, and the batch, are
   written to ``<target>-stage/data``; ``<target>-stage/old`` lists the old
   files. Spark's ``_SUCCESS`` file in ``data``, written last, says that both are whole. As a
   key lies in one month, rows dealt by month and key hash serve both the merge and the files;
4. :func:`finish_stage` moves the stage's files into the target, then deletes the
   old files, then the stage.

A run that dies before the stage is whole leaves the target as it was, and the
next one starts anew. A run that dies in step 4 loses no row: the files that are
still in the stage are moved, the old files that are still there deleted, by
the next upsert or by a reader that calls :func:`finish_stage` (until then rows
may stand twice). Replaying a batch gives the same table.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.schema import CLEAN_COLUMNS, CLEAN_SCHEMA, PK_COLUMNS
from shoplens.session import materialize, path_exists, remove_path
from shoplens.sources.clean_store import PARTITION_COLUMN, with_partition

#: small files that a month may have before an upsert that touches it merges them
SMALL_FILES, SMALL_BYTES = 16, 16 << 20

#: of a batch of so many rows, one key in ``PROBE`` is looked up first
PROBE, PROBE_ROWS = 64, 100_000
#: bytes of a merged file, and of a new row in it, about
FILE_BYTES, ROW_BYTES = 24 << 20, 20

STORED = T.StructType([*CLEAN_SCHEMA.fields, T.StructField(PARTITION_COLUMN, T.DateType())])


def _has_table(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds data (a folder with visible entries)."""
    if not path_exists(spark, path):
        return False
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hpath))


def _stage_path(target_path: str) -> str:
    return f"{target_path.rstrip('/')}-stage"


def _write_months(df: DataFrame, path: str, dealt: bool = False) -> None:
    """``dealt``: the rows lie by month already."""
    ((df if dealt else df.hint("rebalance", PARTITION_COLUMN))
     .sortWithinPartitions(PARTITION_COLUMN, "order_date", "order_id", "product_id")
     .write.partitionBy(PARTITION_COLUMN).parquet(path))


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _data_files(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """``<month folder>/<file>`` of the data files below ``path``: bytes, and that
    name as a URI has it."""
    hpath, fs = _file_system(spark, path)
    found, walk = {}, fs.listFiles(hpath, True)
    while walk.hasNext():
        status = walk.next()
        at = status.getPath()
        if not at.getName().startswith(("_", ".")):
            uri = "/".join(at.toUri().toString().split("/")[-2:])
            found[f"{at.getParent().getName()}/{at.getName()}"] = (status.getLen(), uri)
    return found


def month_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Month folder -> names of its data files."""
    out: dict[str, list[str]] = {}
    for name in _data_files(spark, path):
        month, file = name.split("/")
        out.setdefault(month, []).append(file)
    return out


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Into a folder that exists."""
    from_path, fs = _file_system(spark, source)
    if not fs.rename(from_path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise RuntimeError(f"could not move {source} to {target}")


def _note_old_files(spark: SparkSession, stage: str, files: list[str]) -> None:
    hpath, fs = _file_system(spark, f"{stage}/old")
    out = fs.create(hpath, True)
    out.write(bytearray("".join(f"{f}\n" for f in files).encode("utf-8")))
    out.close()


def finish_stage(spark: SparkSession, target_path: str) -> bool:
    """Bring a whole stage into the target; False if there is none."""
    stage, target = _stage_path(target_path), target_path.rstrip("/")
    if not path_exists(spark, f"{stage}/data/_SUCCESS"):
        return False
    names = _data_files(spark, f"{stage}/data")
    for month in {name.split("/")[0] for name in names}:
        hpath, fs = _file_system(spark, f"{target}/{month}")
        fs.mkdirs(hpath)
    for name in names:
        _move(spark, f"{stage}/data/{name}", f"{target}/{name}")
    for r in spark.read.text(f"{stage}/old").collect():  # a row a file
        remove_path(spark, f"{target}/{r['value']}")
    remove_path(spark, stage)
    spark.catalog.refreshByPath(target)
    return True


def dedup_batch(batch: DataFrame, keys: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """One row per key. With ``order_col`` (e.g. the batch index) the row with
    the largest value wins — last write wins; ties, or no order column, fall
    back to the largest row by the updated columns (deterministic)."""
    keys = keys or PK_COLUMNS
    rest = [c for c in CLEAN_COLUMNS if c not in keys]
    ranked = ([order_col] if order_col else []) + rest
    return (batch.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
            .select(*CLEAN_COLUMNS))


def merge_frames(target: DataFrame, batch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pure upsert semantics: batch rows replace target rows with the same key."""
    keys = keys or PK_COLUMNS
    kept = target.join(batch.select(*keys), keys, "left_anti")
    return kept.select(*batch.columns).unionByName(batch)


def merge_months(touched: DataFrame, batch: DataFrame, keys: list[str], parts: dict) -> DataFrame:
    """:func:`merge_frames` of rows with their month, for keys that lie in one month: the
    rows are shuffled once, a month to ``parts`` parts, and sorted by date in each."""
    columns = [*CLEAN_COLUMNS, PARTITION_COLUMN]
    both = touched.select(*columns, F.lit(False).alias("_new")).unionByName(batch.select(*columns, F.lit(True).alias("_new")))
    per_month = touched.sparkSession.createDataFrame(list(parts.items()), f"{PARTITION_COLUMN} date, _parts int")  # a row a month
    part = F.pmod(F.xxhash64(*keys), F.coalesce("_parts", F.lit(1)))
    dealt = (both.join(F.broadcast(per_month), PARTITION_COLUMN, "left").withColumn("_part", part)
             .repartition(2 * sum(parts.values()), PARTITION_COLUMN, "_part"))
    key = Window.partitionBy(PARTITION_COLUMN, *sorted(keys, key=lambda k: k != "order_date"), "_part")  # the order of the files
    return (dealt.withColumn("_hit", F.max("_new").over(key))
            .where(F.col("_new") | ~F.col("_hit") | ~_has_keys(keys)).select(*columns))


def _parts(files: dict, rows: dict) -> dict:
    """Parts of about ``FILE_BYTES`` that a month's old files and new rows come to."""
    size = {m: n * ROW_BYTES for m, n in rows.items()}
    for name, n in files.items():
        size[_month_of(name)] = size.get(_month_of(name), 0) + n
    return {m: -(-n // FILE_BYTES) or 1 for m, n in size.items()}


def _has_keys(keys: list[str]) -> Column:
    """A row without one of its keys equals no other."""
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _month_of(name: str) -> date | None:
    value = name.split("/")[0].partition("=")[2]
    return date.fromisoformat(value) if value[:1].isdigit() else None


def _narrow(df: DataFrame, keys: list[str], side: str, some: bool) -> DataFrame:
    """Hash of the key; two of the row, which must both be equal for equal rows."""
    nulls = reduce(Column.__add__, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(CLEAN_COLUMNS)])
    rows = df.where(_has_keys(keys)).withColumns({
        "_k": F.xxhash64(*keys), f"_v{side}": F.xxhash64(*CLEAN_COLUMNS, nulls), f"_w{side}": F.xxhash64(nulls, *CLEAN_COLUMNS[::-1])})
    return (rows.where(F.pmod("_k", F.lit(PROBE)) == 0) if some else rows).drop(*CLEAN_COLUMNS)


def _look_up(spark: SparkSession, target_path: str, names: list[str], stored: dict, batch: DataFrame, keys: list[str],
             some: bool) -> list[tuple]:
    """(month, file or None, ok): the files that hold keys of a month's batch rows, and
    whether all these rows stand there, once and equal."""
    uris = {stored[n][1]: n for n in names}
    there = spark.read.schema(STORED).option("basePath", target_path).parquet(*(f"{target_path}/{n}" for n in names))
    there = _narrow(there.withColumn("_file", F.xxhash64(F.substring_index("_metadata.file_path", "/", -2))), keys, "t", some)
    found = (_narrow(batch, keys, "b", some).join(there.drop(PARTITION_COLUMN), "_k", "left")
             .groupBy("_k", PARTITION_COLUMN)
             .agg(F.count("_file").alias("n"), F.min((F.col("_vb") == F.col("_vt")) & (F.col("_wb") == F.col("_wt"))).alias("same"),
                  F.collect_set("_file").alias("files"))  # one, unless the target repeats a key
             .select(PARTITION_COLUMN, ((F.col("n") == 1) & F.coalesce("same", F.lit(False))).alias("ok"), F.explode_outer("files").alias("_file"))
             .groupBy(PARTITION_COLUMN, "_file").agg(F.min("ok").alias("ok")))
    by_hash = spark.createDataFrame([(u,) for u in uris], "uri string").withColumn("_file", F.xxhash64("uri"))  # a row a file
    rows = found.join(F.broadcast(by_hash), "_file", "left").collect()
    return [(r[PARTITION_COLUMN], uris.get(r["uri"]), r["ok"]) for r in rows]


def old_files(spark: SparkSession, target_path: str, batch: DataFrame, per_month: dict, keys: list[str]) -> tuple[dict, set]:
    """Files of the touched months: ``rewrite`` (a key of the batch lies there, or
    one of too many small files) and ``keep``, as {relative name: bytes}; and the months
    that the batch changes. ``per_month``: month -> rows of the batch, rows without a key."""
    stored = {n: f for n, f in _data_files(spark, target_path).items() if _month_of(n) in per_month and _month_of(n)}
    filled = {_month_of(n) for n in stored}
    changed = {m for m, (_, loose) in per_month.items() if loose or m not in filled}
    hit: set = set()

    def look(names: list[str], rows: DataFrame, some: bool) -> None:
        for month, name, ok in _look_up(spark, target_path, names, stored, rows, keys, some) if names else ():
            if not ok:
                changed.add(month)
            if name:
                hit.add((month, name))

    if sum(n for n, _ in per_month.values()) >= PROBE_ROWS:
        look(list(stored), batch, True)
    if "order_date" in keys:
        known = {name for month, name in hit if month in changed}
        rest = [n for n in stored if n not in known]
        look(rest, batch.where(F.col(PARTITION_COLUMN).isin(list({_month_of(n) for n in rest}))), False)
    else:  # a key's rows may lie in several months
        look(list(stored), batch, False)
    rewrite = {name for month, name in hit if month in changed}
    out: dict = {"rewrite": {}, "keep": {}}
    small: dict = {}
    for n, (size, _) in stored.items():
        if size < SMALL_BYTES:
            small[_month_of(n)] = small.get(_month_of(n), 0) + 1
    for n, (size, _) in stored.items():
        many = size < SMALL_BYTES and small[_month_of(n)] > SMALL_FILES and _month_of(n) in changed
        out["rewrite" if n in rewrite or many else "keep"][n] = size
    return out, changed


def upsert(spark: SparkSession, target_path: str, batch: DataFrame, keys: list[str] | None = None,
           order_col: str | None = None) -> dict:
    """Upsert ``batch`` into the table at ``target_path``; ``order_col`` orders
    rows of one key inside the batch (the largest value is applied last)."""
    keys, target = keys or PK_COLUMNS, target_path.rstrip("/")
    finish_stage(spark, target)
    remove_path(spark, _stage_path(target))  # one that isn't whole
    batch = materialize(batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CLEAN_SCHEMA.fields),
                                     *([order_col] if order_col else [])), "upsert_batch")
    # rows of each month the batch touches (bounded by the calendar)
    per_month = {r[PARTITION_COLUMN]: (r["n"], r["loose"]) for r in with_partition(batch).groupBy(PARTITION_COLUMN).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~_has_keys(keys), 1)).alias("loose")).collect()}
    rows_in, loose = (sum(v[i] for v in per_month.values()) for i in (0, 1))
    # as many hashes as rows: as many keys; otherwise the keys themselves are counted
    rows_out = 0 if not rows_in else batch.agg(F.count_distinct(F.xxhash64(*keys))).first()[0]
    if loose or rows_out < rows_in:
        rows_out = batch.agg(F.count_distinct(*[F.col(k) for k in keys])).first()[0]
    months, files, changed = [m for m in per_month if m], {"rewrite": {}, "keep": {}}, set(per_month)
    # the key-level de-duplication (an aggregate) only when needed
    clean = with_partition(batch.select(*CLEAN_COLUMNS) if rows_in == rows_out else dedup_batch(batch, keys, order_col))
    if rows_in and _has_table(spark, target):
        files, changed = old_files(spark, target, clean, per_month, keys)
    if changed:
        if len(changed) < len(per_month):
            clean = clean.where(F.col(PARTITION_COLUMN).isin([m for m in changed if m])
                                | (F.col(PARTITION_COLUMN).isNull() & F.lit(None in changed)))
        by_month = bool(files["rewrite"]) and "order_date" in keys
        if files["rewrite"]:
            touched = spark.read.schema(STORED).option("basePath", target).parquet(*(f"{target}/{f}" for f in files["rewrite"]))
            clean = (merge_months(touched, clean, keys, _parts(files["rewrite"], {m: per_month[m][0] for m in changed if m}))
                     if by_month else merge_frames(touched, clean, keys))
        stage = _stage_path(target)
        _note_old_files(spark, stage, list(files["rewrite"]))
        _write_months(clean, f"{stage}/data", by_month)
        finish_stage(spark, target)
    remove_path(spark, batch.written_at)
    return {"rows_in": rows_in, "rows_upserted": rows_out,
            "duplicate_keys_dropped": rows_in - rows_out, "months_touched": len(months),
            "files_rewritten": len(files["rewrite"]), "bytes_rewritten": sum(files["rewrite"].values()),
            "files_kept": len(files["keep"])}
