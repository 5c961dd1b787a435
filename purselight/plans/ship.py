"""Sends the package to the executors, whose Python workers need not find it on a path of their own."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip file of this package to the session's Python files, once in an application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="purselight-")  # the driver serves the file while the application lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "purselight.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("purselight", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which first sees to it that workers can import the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
