"""A folder that driver and executors share, for files a query writes and reads back."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

_own: list[str] = []


def _base(spark) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lichenmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def scratch_path(spark, name: str) -> str:
    """A fresh local-file path below ``spark.checkpoint.dir``, or in local mode below a folder of our own where that is unset."""
    base = _base(spark)
    if "://" in base and not base.startswith("file:"):
        raise ValueError("file round trips need a checkpoint folder on a shared file system")
    path = f"{base.removeprefix('file://').removeprefix('file:')}/{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"{path}/{name}"


def scratch_table(spark, name: str) -> str:
    """The same for a table that Spark writes and reads, whatever the store; it goes with the driver."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(clean)
    return path
