"""Session construction and the shared work folder.

On a cluster the work folder is the shared ``spark.checkpoint.dir`` that the
cluster names; we read it from the session. Only when it is unset (local
tests) do we fall back to a fresh temporary folder and register it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key also where that costs a later operator another shuffle (the
    # de-duplication shares the partitioning of the last order_id joins)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole-day NTZ timestamps come straight from parquet; no tz shifting
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "shoplens",
              extra: dict | None = None) -> SparkSession:
    """A session with ``DEFAULT_CONF``. The master and the number of shuffle
    partitions are the submitted ones unless given (as local runs do)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, registering one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        # one machine only, as in tests
        configured = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # strip the per-application uuid Spark appends, keep our own tree
    return f"{base}/shoplens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the work folder and read it back: several readers then
    share one run of its plan, and a lost executor costs a re-read only."""
    path = work_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path  # for who knows its last reader
    return table


@contextmanager
def _with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def folders_as_they_come(spark: SparkSession, folders: int = 256):
    """Partitioned writes inside keep up to ``folders`` files open a task instead of
    sorting its rows by folder: for rows read from files that hold few folders each."""
    return _with_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", str(folders))


def shuffles_dropped(spark: SparkSession):
    """Jobs inside remove their shuffle files as they end; otherwise these lie until the driver
    happens to collect its garbage, those of all steps beside each other. For writes: nothing
    reads their shuffles again."""
    return _with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def remove_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
