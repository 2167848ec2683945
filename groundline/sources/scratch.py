"""Scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The scratch folder of a session that names none (tests, local mode).
_OWN: dict[str, str] = {}
#: Scratch tables of this driver that are still there.
_TABLES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode, where driver
    and executors are one machine; elsewhere an error, since executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="groundline-")
    return _OWN["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`clear` deletes."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes this driver's scratch tables and counts them. Results that are still lazy may read them, so call it once they are written."""
    n = len(_TABLES)
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
