"""Session factory with the settings the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes partitions and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "weftlink", master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one; settings override the defaults. The cluster manager's master stays unless one is given."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
