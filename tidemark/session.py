"""Session defaults. On a cluster the submitting job's own settings win."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one entry per id or day of keyed stream state: kept off the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


_fallback: list[str] = []


def local_session(cores: int = 8, name: str = "tidemark", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        # call-site capture costs a driver round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory for one run, under the shared folder named by the session.

    Executors on other hosts must see it, so a machine-local temporary folder is only
    used where the session names no folder and runs on one machine, as in tests; elsewhere a
    session without a folder fails here.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder; the master is {master}")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="tidemark-"))
        shared = _fallback[0]
    return f"{shared.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"
