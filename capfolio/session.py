"""Session settings the plans rely on or gain from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: coalesced partitions, measured broadcasts, split hot keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key also where that costs the next operator another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Only read when a session starts.
START_SETTINGS = {
    # Do not record a Python call site for every Column; wide plans have thousands.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepared(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with all settings."""
    for key, value in {**SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder


def configure(spark: SparkSession) -> SparkSession:
    """The settings that can still change, on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
