"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; a temporary folder only
    where none is set and all runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()  # the context adds a folder of its own below it
        root = os.path.dirname(known) if known else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lanemill-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: later steps neither recompute ``df`` nor depend on executors that held it."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if urlparse(path).scheme in ("", "file"):  # elsewhere the store's own expiry clears the folder
        atexit.register(shutil.rmtree, unquote(urlparse(path).path), True)
    return df.sparkSession.read.schema(df.schema).parquet(path)
