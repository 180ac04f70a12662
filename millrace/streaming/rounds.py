"""Rounds of candidates as a stream: new keys are kept until a target is reached or rounds stay flat.

Keys are the state of a stateful operator, spread over the executors by key, so a round is compared with all earlier ones
without reading them again. What ends the loop is one number a round. The stream resumes from its checkpoint: the operator's
state, the rows kept and the rounds' gains are those of the last batch that was committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.operators.instruct import keep_first
from millrace.sources.store import file_system

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, by ``order``, once in the life of the stream."""

    def __init__(self, order: list[str], columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:  # one row is held at a time, however many a key has
            first = frame.sort_values(self.order).head(1)
            best = first if best is None else pd.concat([best, first]).sort_values(self.order).head(1)
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best[self.columns]

    def close(self) -> None:
        pass


def new_of_stream(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of ``stream`` whose key no earlier batch had, the first by ``order`` within a batch."""
    processor = FirstOfKey(order, stream.columns)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append", timeMode="None")


def finished(gains: list[tuple[int, int]], target: int, least_gain: int, patience: int) -> int | None:
    """The round that ends the loop, from (round, new keys) in order, or None if it goes on."""
    held = low = 0
    for number, n in gains:
        held, low = held + n, low + 1 if n < least_gain else 0
        if held >= target or low >= patience:
            return number
    return None


def run_rounds(stream: DataFrame, folder: str, key: str, turn: str, ordinal: str, target: int, least_gain: int, patience: int, batches: int | None = None) -> DataFrame:
    """First rows by ``key`` of the rounds (``turn``) of a stream up to the one that ends the loop, ``target`` rows at most, in order.

    Batches bring rounds in order; a round may be split over batches. ``folder`` keeps the state: a call with the same folder goes
    on where the last one ended, be it after ``batches`` batches, a failure or the end of what had arrived. Every batch writes its rows and its rounds under its
    own number, so one that is run again replaces what it wrote before.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kept, turns = StructType(stream.schema.fields), StructType([stream.schema[turn]])
    done: list[int] = []

    # The marks of rounds travel through the operator as rows of a key of their own, so that rounds without a new row count.
    marks = stream.withColumn(key, F.concat(F.lit("\u0000"), F.col(turn).cast("string"))).withColumn(ordinal, F.lit(-1).cast(stream.schema[ordinal].dataType))
    marked = stream.union(marks)

    def write(batch: DataFrame, number: int) -> None:
        is_mark = F.col(key).startswith("\u0000")
        batch.persist()
        batch.where(~is_mark).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.where(is_mark).select(turn).write.mode("overwrite").parquet(f"{folder}/rounds/batch={number}")
        batch.unpersist()
        done.append(number)

    def table(name: str, schema: StructType) -> DataFrame:
        fs, path = file_system(spark, f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}") if fs.exists(path) else spark.createDataFrame([], schema)

    def last() -> int | None:
        gains = table("rounds", turns).select(turn).distinct().join(table("rows", kept).groupBy(turn).agg(F.count(F.lit(1)).alias("n")), turn, "left")
        return finished([tuple(r) for r in gains.select(turn, F.coalesce("n", F.lit(0))).orderBy(turn).toLocalIterator()], target, least_gain, patience)

    query = None if last() is not None else new_of_stream(marked, key, [turn, ordinal]).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    seen = 0
    while query is not None and not query.awaitTermination(1):
        if len(done) > seen:
            seen = len(done)
            if (batches is not None and seen >= batches) or last() is not None:
                query.stop()
                break
    end = last()
    rows = keep_first(table("rows", kept), key, turn, ordinal)
    return (rows if end is None else rows.where(F.col(turn) <= F.lit(end))).orderBy(turn, ordinal).limit(target)
