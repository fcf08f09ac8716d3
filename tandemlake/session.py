"""A session with the settings that the queries are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "tandemlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with conf; adaptive execution and UTC where neither conf nor the cluster's own settings say otherwise.

    In local mode there are two shuffle partitions for each core; a cluster's number is its own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    named = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    for key, value in (DEFAULTS | ({"spark.sql.shuffle.partitions": str(2 * (os.cpu_count() or 4))} if local else {})).items():
        if named.get(key) is None:
            spark.conf.set(key, value)
    return spark
