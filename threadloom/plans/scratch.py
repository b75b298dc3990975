"""A folder that driver and executors share, for what a session derives from its inputs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: str | None = None
_built: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is not set and Spark is one process, a temporary one."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="threadloom-")
            atexit.register(shutil.rmtree, _local, True)
        base = _local
    base = f"file://{base}" if base.startswith("/") else base
    return f"{base.rstrip('/')}/engine/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def built(spark: SparkSession, what: str, build) -> str:
    """The folder where ``build`` (a function of a path) put something in this application; built when it is first asked for."""
    key = spark.sparkContext.applicationId, what
    path = _built.get(key)
    if path is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    path = shared_dir(spark)
    build(path)
    _built[key] = path
    return path
