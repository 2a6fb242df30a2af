"""Session settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC so that timestamps agree between engines; adaptive execution splits skewed joins and sizes shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("marquee").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
