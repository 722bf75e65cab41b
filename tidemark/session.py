"""Session defaults for this library; every setting can be overridden by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tidemark", **conf: str) -> SparkSession:
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(app).config(map=defaults | conf).getOrCreate()
