"""Written intermediate tables in the shared folder the session names."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_veiltab").rstrip("/")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """Fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/veiltab-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table as Parquet in the shared folder and go on from the written copy.

    Lineage ends there, the copy survives lost executors, and later reads prune its columns.
    """
    spark = df.sparkSession
    void = {c: F.lit(None).cast("string") for c, t in df.dtypes if t == "void"}
    df = df.withColumns(void) if void else df
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
