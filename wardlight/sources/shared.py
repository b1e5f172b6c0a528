"""Tables that a job reads several times, kept in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset a temporary folder in local mode, on a cluster an error."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="wardlight-shared-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once and read again, so that nothing before it is done twice or lost with an executor."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes what keep() has written in this session's folder, once its readers are done; how many tables it was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("kept-")]
    return sum(bool(fs.delete(p, True)) for p in found)
