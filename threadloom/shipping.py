"""This package for Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the application's executors, once; Spark's own file server hands it out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, f"{name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        z.write(os.path.join(at, f), os.path.join(name, os.path.relpath(os.path.join(at, f), root)))
        kept = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
        os.replace(path, kept)
    context.addPyFile(kept)
    _shipped.add(context.applicationId)
