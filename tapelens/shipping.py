"""Sends this package to the executors, so that Python functions find it wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tapelens-ship-"), "tapelens.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark
