"""Shared-folder staging of small results that several steps read."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``; where that is unset, a folder in the
    warehouse, unless that lies on the disk of one machine of a cluster. Only session settings
    are read, and none is changed, so any kind of session will do.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    warehouse = spark.conf.get(WAREHOUSE_DIR)
    one_machine = (spark.conf.get("spark.master", None) or "").startswith("local")
    if urlsplit(warehouse).scheme in ("", "file") and not one_machine:
        raise ValueError(f"{warehouse} is not shared by a cluster; set {CHECKPOINT_DIR}")
    return f"{warehouse.rstrip('/')}/staged"


def scratch_location(spark: SparkSession, name: str) -> str:
    """A fresh location below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, location: str | None = None) -> DataFrame:
    """Compute ``df`` once and keep it as files, so later steps survive lost executors."""
    spark = df.sparkSession
    location = location or scratch_location(spark, "staged")
    df.write.parquet(location)
    return spark.read.schema(df.schema).parquet(location)
