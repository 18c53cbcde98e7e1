"""Cutting lineage: frames written to the folder that driver and executors share.

Everything a session writes lies in one folder of its own there; cleanup() removes it once results have been read or saved.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    return _runs[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession) -> str | None:
    """A folder for tasks' own files in the shared one, as a path that Python can open; None where it has none."""
    where = run_dir(spark)
    if where.startswith("file:"):
        where = "/" + where[5:].lstrip("/")
    if not where.startswith("/"):
        return None
    os.makedirs(f"{where}/scratch", exist_ok=True)
    return f"{where}/scratch"


def cleanup(spark: SparkSession) -> None:
    """Remove all that written() has kept for this application; frames built on it can't be read afterwards."""
    where = _runs.pop(spark.sparkContext.applicationId, None)
    if where:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
