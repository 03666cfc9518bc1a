"""Sessions for the engine, and shipping it to a cluster's workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "folia", **config) -> SparkSession:
    """A session with adaptive execution on; everything else is the cluster's. Underscores in config's names stand for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for name, value in config.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, where it isn't installed there."""
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="folia-"), "folia"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
