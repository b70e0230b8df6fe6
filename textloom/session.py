"""Session helpers shared by every entry point: local sessions, the folder that driver and executors share, tables written there."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parent.parent)
_WRITTEN: list[tuple[SparkSession, str]] = []
_KEPT: dict[tuple[str, str], DataFrame] = {}


def local_session(app: str = "textloom", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local run import this package from wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a temporary one of our own, but only
    if driver and executors are one process; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for forget() to delete."""
    path = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors. The shuffles that the write
    needed are deleted at its end, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def file_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path, through Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode(), usedforsecurity=False).hexdigest()


def once(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """materialize(make()) the first time that a table of this name is asked for over the files at `source` in an application; the same
    again for as long as those files are the same."""
    key = (spark.sparkContext.applicationId, f"{label} {source} {file_state(spark, source)}")
    if key not in _KEPT:
        _KEPT[key] = materialize(make(), label)
    return _KEPT[key]


def forget(spark: SparkSession) -> None:
    """Deletes what materialize() and users of scratch() have written for this session; call it when the results have been stored."""
    jvm = spark.sparkContext._jvm
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    for session, path in list(_WRITTEN):
        if session is spark:
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            _WRITTEN.remove((session, path))


@atexit.register
def _sweep() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        try:
            if spark.sparkContext._jsc is not None:
                forget(spark)
        except Exception:  # the JVM may be gone already
            return
