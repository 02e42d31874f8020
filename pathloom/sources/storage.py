"""Tables of a run in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and Spark runs in one process (tests, laptops) a local one is made and set; on a cluster, whose executors would each write to their own disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = f"file://{tempfile.mkdtemp(dir='/tmp/checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove an existing folder when the driver ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def hollow(t: S.DataType) -> bool:
    """Whether a type holds a struct without fields, which Parquet cannot store."""
    if isinstance(t, S.StructType):
        return not t.fields or any(hollow(f.dataType) for f in t.fields)
    return isinstance(t, S.ArrayType) and hollow(t.elementType)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows as a scan of files written now: of a table, or of a reliable checkpoint where Parquet has no type for them."""
    place = folder(spark)
    if hollow(df.schema):
        spark.sparkContext.setCheckpointDir(place)
        return df.checkpoint()
    path = f"{place}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
