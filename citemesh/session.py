"""Session factory: ANSI on, UTC, adaptive execution with skew joins."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "citemesh", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()
