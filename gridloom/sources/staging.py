"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder. Without either, a temporary folder in local mode, where all run on
    one machine; on a cluster ValueError."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._gridloom_path = path
    return found


def discard(*staged: DataFrame) -> None:
    """Removes what stage() has written, once nothing that is still to be computed reads it."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
