"""The session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC times, ANSI arithmetic, run-time re-planning and Arrow exchange with Python.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM doesn't compile longer methods: such a stage is faster as separate projections
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(app: str = "sunfleet", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
