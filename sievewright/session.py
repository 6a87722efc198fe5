"""Session settings the engine relies on; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for comparable timestamps; the last of equal map keys wins, as in an ordered dictionary.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true"}


def session(name: str = "sievewright", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | conf).getOrCreate()
