"""Where written intermediate results and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Local sessions without that setting (tests) get a new temporary folder. A
    cluster session without it is refused: executors could not see each other's
    local folders.
    """
    leaf = f"{purpose}-{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{leaf}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"rollcall-{purpose}-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
