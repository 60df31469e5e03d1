"""Session helpers: table access, materialisation in the shared folder, code for the workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is proven small enough to be broadcast.
BROADCAST_ROWS = 100_000
_own_dir: list[str] = []
_shared: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, as the session names it.

    A local one, removed at exit, stands in only where all runs on one machine and the session names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        own = f"{base.rstrip('/')}/rankloom-{spark.sparkContext.applicationId}"
        if own not in _shared:
            _shared.append(own)
            atexit.register(drop_tables, spark)
        return own
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        own = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir.append(f"file://{own}")
    return _own_dir[0]


def drop_tables(spark: SparkSession) -> None:
    """Remove what materialize wrote for this application; frames that read it are void after that.

    Nothing happens where the session has ended, as at the end of a process that stopped it first.
    """
    with contextlib.suppress(Exception):
        for own in _shared:
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _shared.clear()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to hold at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that can't import it (the driver's path is not theirs)."""
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_rankloom", False):
        return
    target = Path(tempfile.mkdtemp(prefix="rankloom-code-")) / "rankloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._rankloom = True
