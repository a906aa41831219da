"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and everything runs in one process."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lumenseek-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: its lineage ends there, so a lost executor costs a
    reread and rows never change between two uses. The folder is named lumenseek/<random>-<name>."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenseek/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned; nothing that is still to run may read them."""
    for table in tables:
        if path := _paths.pop(table, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
