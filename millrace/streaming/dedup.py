"""Keep-first deduplication of a stream, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.operators.instruct import new_rows


def stream_new_rows(stream: DataFrame, table: str, checkpoint: str, key: str, *order: str) -> StreamingQuery:
    """Appends to the Parquet ``table`` the first row of every key that it does not hold, batch by batch.

    The table is the state, so it is unbounded only on disk. A batch that is run again after a failure first
    removes what its earlier run has written: rows carry the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = stored(spark, table, batch)
        fresh = new_rows(batch, known.where(F.col("batch") < number), key, *order)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, table: str, like: DataFrame) -> DataFrame:
    """The rows of ``table`` so far, with their ``batch``; none if it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    schema = StructType([*like.schema.fields, StructField("batch", IntegerType())])
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(table)


def events_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: (start, event_type, n, value) by event-time window; rows later than ``late`` are left out in a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
