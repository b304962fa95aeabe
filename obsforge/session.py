"""Session settings the operators are written for, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime settings. Sizes are Spark's own defaults or the values that make
# adaptive execution split a hot partition even when that costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "obsforge", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; extra settings use `__` for the dots in their names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables and stream checkpoints that must outlive an executor.

    Its parent is what the session names in ``spark.checkpoint.dir``, else its
    warehouse: folders that every executor reaches.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not parent:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
