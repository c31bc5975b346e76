"""What plans need of a session: tables in the folder that driver and executors share, and this package's code on workers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sonoframe-code-"), "sonoframe.zip")  # the driver serves it, executors fetch it
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(os.path.realpath(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sonoframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts lineage: a lost executor costs a reread of the table, not a recomputation of what led to it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables were staged so far: release() deletes those after a mark."""
    return len(_made)


def release(since: int = 0, keep_last: bool = False) -> None:
    """Deletes the tables that this process staged after the mark `since`; with keep_last all but the last of them."""
    gone = _made[since : len(_made) - keep_last]
    del _made[since : len(_made) - keep_last]
    for spark, path in reversed(gone):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: S112  the session may be gone already; the folder is then the cluster's to clean
            continue
