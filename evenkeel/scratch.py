"""Where files may be written that driver and executors both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from evenkeel.errors import ReconError


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, which only a local master allows, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ReconError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='evenkeel-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
