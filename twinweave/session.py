"""Session defaults and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution sizes shuffles and splits skewed joins at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "twinweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_twinweave_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="twinweave-ship-")
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(folder, "twinweave_package"), "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._twinweave_shipped = True
