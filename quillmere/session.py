"""Session builder with the settings that the library expects."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> str:
    """Sends this package to the executors, for sessions whose workers don't have it installed; gives the archive's path."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "quillmere.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    return archive


def session(master: str | None = None, app: str = "quillmere", **conf: str) -> SparkSession:
    """UTC, AQE with skew joins and coalescing, Arrow for Python. On a cluster leave master unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
