"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir; a temporary one is made only where the
    session names none and runs on this machine alone (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            at = known.get()
        elif spark.sparkContext.master.startswith("local"):
            at = tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{at}/{name}-{uuid.uuid4().hex}"
