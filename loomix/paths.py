"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomix-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark is local, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomix/{uuid.uuid4().hex}/{name}"
