"""The package's code, brought to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import gapwright


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for
    those that do not find it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_gapwright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(gapwright.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "gapwright"), "zip", root, "gapwright")
    context.addPyFile(archive)
    context._gapwright_shipped = True
