"""Session helpers: the shared work folder, materialised tables and measured sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if its planned size is at most this many bytes. Written tables count compressed; in memory they take up to some ten times that.
BROADCAST_LIMIT = 4 * 1024 * 1024

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="siltstone-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package, archive = Path(__file__).parent, os.path.join(folder, "siltstone.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and everything runs on this machine, as in
    tests, a folder of our own is made and removed at exit; on a cluster this raises ``RuntimeError``.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = "file://" + root
        spark.sparkContext.setCheckpointDir("file://" + root + "/rdd")
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed at exit if it is a local one."""
    path = f"{work_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, local_path(path), ignore_errors=True)
    return path


def clear(spark: SparkSession) -> int:
    """Delete every folder :func:`new_path` has named in this application; how many there were.

    For long sessions: results that have not been written elsewhere can't be read any more afterwards.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def local_path(uri: str) -> str:
    """``file:`` URI or plain path as a plain path."""
    if uri.startswith("file://"):
        return uri[len("file://") :]
    return uri[len("file:") :] if uri.startswith("file:") else uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or local path, for tasks that read or write files themselves, and the path in it."""
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that outlive executors; a lost executor
    costs nothing but its running tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for a written table); runs no job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size.toString()) if not isinstance(size, int) else size


def task_count(spark: SparkSession, amount: int, per_task: int) -> int:
    """Number of tasks so that none gets more than about ``per_task`` of ``amount`` rows or bytes; at least that of shuffles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // per_task))
