"""Places that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, local mode gets one of its own; a cluster must name one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every run has its own. What stands there goes when the application ends."""
    path = f"{shared_dir(spark)}/shelfmark-{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, so that a lost
    executor costs only the running stage, and whatever follows reads one and the same rows."""
    return _written(df, scratch(df.sparkSession, name))


class Shelf:
    """The tables of one run, in a folder of the shared folder; those that nothing will read any more can go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """As settle()."""
        return _written(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = _hadoop(self.spark, f"{self.path}/{name}")
            fs.delete(at, True)


#: Schemes under which Spark knows a store that pyarrow knows under another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def store_uri(folder: str) -> str:
    """A folder's name as pyarrow knows it."""
    scheme, _, rest = folder.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if rest else folder


def file_system(folder: str):
    """(file system, path) of a folder as executors read and write it: file, hdfs, viewfs, s3, gs and abfs schemes
    (the Hadoop ones need libhdfs). Raises for others, on the driver too, so that a job fails before it runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_uri(folder))
