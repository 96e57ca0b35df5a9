"""Tables that are written once and read again, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder of the application's own where that is unset and everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="siltwork-")
    return _LOCAL[app]


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its plan runs once, however often the result is used. Goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
