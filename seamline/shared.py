"""Tables written to the folder that all executors share, to cut lineage.

A written table survives the loss of any executor, and reads of it are pruned
and split like those of any other Parquet table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master (tests) gets a new temporary folder that the session keeps; on a cluster it is an error, as executors do not see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seamline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seamline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has staged. Results that read them must have been written or collected before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/seamline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
