"""Session settings and the shared work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()
_SCOPE: ContextVar[str | None] = ContextVar("_SCOPE", default=None)


def build_session(master: str = "local[8]", app: str = "stayline", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a folder of our own only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get(WORK_DIR_SETTING, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {WORK_DIR_SETTING} to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="stayline-")
    context.setCheckpointDir(own)
    return own


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, so that two runs never collide."""
    return f"{_SCOPE.get() or f'{work_dir(spark)}/stayline'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """Everything that is stored by the way inside the block is removed at its end.

    Store the result inside: frames that still read such files cannot be used afterwards.
    """
    folder = work_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once an application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='stayline-ship-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
