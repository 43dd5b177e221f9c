"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int | None = None, **settings: str) -> SparkSession:
    """Get or make a session: adaptive execution, UTC, and shuffle partitions to suit the cores. Other settings override these."""
    builder = SparkSession.builder.appName("phraseloom")
    if master:
        builder = builder.master(master)
    chosen = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if cores:
        chosen["spark.sql.shuffle.partitions"] = str(cores)
    chosen |= {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
