"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the whole package once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="leafmill-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "leafmill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    context.addPyFile(path)
    context._leafmill_shipped = True
