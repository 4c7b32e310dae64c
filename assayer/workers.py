"""Lets the Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Workers get the folder of the package on their path, for a driver that found it by sys.path alone; on a cluster use --py-files."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = ROOT + (os.pathsep + have if have else "")
