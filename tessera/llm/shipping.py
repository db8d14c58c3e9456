"""Lets Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the folder of the package to the workers' path, for runs from a source folder.
    Where the package is installed, or handed over with --py-files, this changes nothing."""
    root = str(Path(__file__).resolve().parents[2])
    told = spark.sparkContext.environment
    paths = told.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        told["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
