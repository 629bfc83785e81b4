"""Tables written between the steps of one operator.

Steps that several later steps read are written once as Parquet below the
folder that ``spark.checkpoint.dir`` names, which driver and executors share.
A lost executor then costs a re-read, never a recomputation of the whole
lineage.  Only where the setting is missing (tests, notebooks on one machine)
a folder of our own is made.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-regatta-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; if unset, a new local one where one machine is driver and executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back, with its own short lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/regatta-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files of finished steps
    return spark.read.schema(schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
