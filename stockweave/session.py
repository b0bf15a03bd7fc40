"""Session helpers: shipping the package to executors and writing intermediate tables to shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import RDD, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch that is handed to a Python worker.
ARROW_BATCH_BYTES = 8 << 20
#: Independent pieces of a query whose jobs are handed to Spark at once.
AT_ONCE = 4


def attach(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound the size of their Arrow batches: for the whole session,
    unless it has set a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("-1", str((1 << 31) - 1), str((1 << 63) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_stockweave_attached", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="stockweave-"), "stockweave_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._stockweave_attached = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary
    folder (tests); on a cluster that is an error, as executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stockweave-shared-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/stockweave/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a whole table: Spark marks it last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() wrote for df; nothing may read it any more."""
    own = work_dir(df.sparkSession)
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/stockweave/" in folder and folder.rsplit("/", 1)[0].endswith(own.split(":", 1)[-1].lstrip("/")):
            _delete(df.sparkSession, folder)


def set_checkpoints(spark: SparkSession) -> None:
    """Have RDD.checkpoint() write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def discard_checkpoint(spark: SparkSession, rdd: RDD) -> None:
    """Delete what rdd.checkpoint() wrote; nothing may read it any more."""
    if rdd.getCheckpointFile():
        _delete(spark, rdd.getCheckpointFile())


def release(spark: SparkSession) -> None:
    """Delete every table that this application has materialised. Results that still read one must be written before."""
    _delete(spark, work_dir(spark))


def side_by_side(spark: SparkSession, makes: Sequence[Callable]) -> list:
    """What each of the independent makes returns, in their order; their Spark jobs run at once, so that small jobs of one
    fill the cores that another's leave idle. The first one's error is raised, after all have ended."""
    attach(spark)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
