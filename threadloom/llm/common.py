"""Shared plumbing: input tables, the shared scratch folder, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The characters that separate words in the operators on ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"

_scratch: dict[str, list[str]] = {}
_own: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_of(df: DataFrame, *columns: str):
    """The named columns, or all, as one struct column ``row``: so an operator's own names can't clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in columns or df.columns]).alias("row")


def unpacked(df: DataFrame, columns) -> list:
    """The fields of ``row`` as columns again."""
    return [F.col(f"row.{quoted(c)}").alias(c) for c in columns]


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they run."""
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and Spark runs in one process is a temporary folder used.
    """
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="threadloom-")
            atexit.register(remove_tree, _own)
        base = _own
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    path = f"{base.rstrip('/')}/llm/{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.

    A lost executor takes none of it along, and nothing above is computed again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application staged; results not yet read are lost with it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def open_fs(uri: str):
    """(file system, path) of a URI, for Python on driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``: file sizes for a plain scan, 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


#: A written table that may be broadcast: so many rows and bytes on disk at most, at some ten times the size in memory.
SMALL_ROWS, SMALL_BYTES = 1 << 20, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is within these bounds; else a join with it is left to shuffle."""
    return F.broadcast(df) if plan_bytes(df) <= SMALL_BYTES and df.count() <= SMALL_ROWS else df


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a table's texts: by the files' sizes, and where those are not known by reading the column."""
    return plan_bytes(df) or df.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first().n or 0


def remainder(column: str, by: int):
    """crc32 of an id's text modulo ``by``; null ids count as remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def remove_tree(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)
