"""Session settings the engine relies on: UTC times, adaptive execution, dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "scrollmine", **settings: str) -> SparkSession:
    """The active session, or a new one, with SETTINGS and then the caller's own."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    for key, value in {**SETTINGS, **settings}.items():
        spark.conf.set(key, value)
    return spark
