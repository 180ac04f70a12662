"""Tables in a folder that all executors share, in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` computed once, written to ``path`` and read from there: its lineage ends at the files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, found = file_system(spark, path)
    fs.delete(found, True)


def passing(spark: SparkSession, path: str) -> str:
    """``path`` made as a folder that goes when the driver ends."""
    fs, found = file_system(spark, path)
    fs.mkdirs(found)
    fs.deleteOnExit(found)
    return path
