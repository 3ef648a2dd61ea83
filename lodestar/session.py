"""Session settings shared by the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the caller brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application, wherever they were started."""
    context = spark.sparkContext
    if not getattr(context, "_lodestar_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="lodestar-")
        # Executors fetch it as long as the application runs.
        atexit.register(shutil.rmtree, folder, True)
        archive = shutil.make_archive(os.path.join(folder, "lodestar"), "zip", root, "lodestar")
        context.addPyFile(archive)
        context._lodestar_shipped = True
    return spark
