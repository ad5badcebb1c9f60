"""What queries need of the cluster: a folder that all executors share, and workers that find this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is installed or sent along."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
