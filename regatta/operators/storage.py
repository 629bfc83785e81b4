"""Tables written between the rounds of an iterative operator, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-regatta-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where one machine is both."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: the lineage is cut and nothing is computed twice."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/regatta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete the files of a table made by ``checkpointed`` that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
