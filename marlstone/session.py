"""The Spark session the engine expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "10000000",
}


def session(app: str = "marlstone", **extra: str) -> SparkSession:
    """A session with the engine's settings; a cluster's own master and sizes stay as submitted."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: installed there, or sent with --py-files)."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def prepare(spark: SparkSession) -> SparkSession:
    """Set what can still be set on a running session, and register the JSON functions."""
    from .functions.jsonb import register

    reachable(spark)
    for key, value in SETTINGS.items():
        if not key.startswith("spark.sql.adaptive"):
            spark.conf.set(key, value)
    register(spark)
    return spark
