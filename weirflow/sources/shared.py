"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, if all of Spark runs on this machine; an error otherwise."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_weirflow_tables", None)
    if own is None:
        own = sc._weirflow_tables = tempfile.mkdtemp(prefix="weirflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a DataFrame as Parquet to the shared folder and reads it back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/weirflow-{re.sub('[^a-z0-9]+', '-', label.lower())}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_weirflow_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
