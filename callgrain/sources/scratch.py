"""Folders for intermediate tables that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session without that setting (tests) gets a temporary folder of its own; on a
    cluster a machine-local folder would lose rows, so there the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="callgrain-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_root`, removed when the interpreter ends."""
    path = f"{shared_root(spark)}/callgrain-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove, spark)
    _made.append(path)
    return path


def _remove(spark: SparkSession) -> None:
    while _made:
        path = _made.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
