"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings this library is written for. The caller's session decides; nothing
# here sets a master, memory or a partition count.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the hot partition of a join even if a later operator then needs
    # one more exchange: one more exchange is cheaper than one huge task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_base: str | None = None


def scratch_base(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Falls back to a temporary folder if driver and executors are one process; any
    other session without the setting is an error, as a machine-local folder would
    be lost with its executor. Nothing below the folder is needed once the session
    is over.
    """
    global _local_base
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="halfstar-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
    return _local_base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for ``name`` below the scratch folder."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative jobs a checkpoint folder, unless the context has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_base(spark))
