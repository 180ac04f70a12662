"""Plumbing shared by the training-data operators.

Everything here survives the loss of an executor: intermediate tables are cut with a
reliable ``checkpoint()`` in the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever comes first; they bound the memory of a Python worker.
TEXT_ROWS, BATCH_BYTES = 512, 64 << 20
#: Rows of one or two numbers that are broadcast at most, some 30 MB.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Point checkpoints at the shared folder and bound Arrow batches.

    A temporary folder stands in for the shared one in local mode only; a cluster without ``spark.checkpoint.dir`` is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def without(docs: DataFrame, bad: DataFrame, condition: Column | str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` less the rows that ``bad`` (a few numbers a row, already cut) matches.

    Up to ``most`` rows, which are counted, go to every task, so that no text is shuffled; more meet ``docs`` in a shuffle.
    """
    return docs.join(F.broadcast(bad) if bad.count() <= most else bad, condition, "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of consecutive rows with equal ``keys`` in a partition that is sorted by them.

    Holds one group and one batch at a time, so the callers bound the size of a group.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change), len(frame)]
        same = bool(held) and all(held[-1][k].iloc[-1] == v[0] for k, v in zip(keys, values, strict=True))
        if held and not same:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(starts, starts[1:], strict=False):
            held.append(frame.iloc[a:b])
            if b < len(frame):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of consecutive rows with equal ``keys``, numbered in ``_group``: many small groups at a time.

    The last group of a batch waits for the next one, so a frame holds one batch and one group at most.
    """
    held: pd.DataFrame | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.to_pandas()
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        change = np.zeros(len(frame), dtype=bool)
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        frame["_group"] = np.cumsum(change)
        last = int(np.searchsorted(frame["_group"].to_numpy(), frame["_group"].iloc[-1]))
        held = frame.iloc[last:].drop(columns="_group")
        if last:
            yield frame.iloc[:last]
    if held is not None:
        yield held.assign(_group=0)


def pairs_within(end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of all pairs with i < j < ``end[i]``, about ``most`` pairs, and one i at least, at a time."""
    n = len(end)
    count = np.maximum(end - np.arange(n) - 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        own = count[at:to]
        i = np.repeat(np.arange(at, to), own)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], own)
        at = to


def crowded(keyed: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Work groups of bounded size for the buckets with two members or more.

    ``keyed`` has one row per (bucket, member). A bucket of up to ``block`` members is one group. A larger
    one is dealt into blocks by a hash of the member, and every two blocks meet in one group, so that each
    pair of a bucket shares a group while no group exceeds about two blocks. Adds the group's blocks ``_a`` and
    ``_b`` and the member's own block ``_own``.

    The members of larger buckets are dealt where they are, by a broadcast of the ``BROADCAST_ROWS`` largest ones; only
    the others meet their bucket's size in a shuffle, and none of these holds more than one row in that many.
    """
    sizes = cut(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    large = cut(sizes.where(F.col("_n") > block).orderBy(F.desc("_n"), key).limit(BROADCAST_ROWS))
    if large.isEmpty():
        many = keyed.join(sizes, key)
    else:
        rest = keyed.join(F.broadcast(large.select(key)), key, "left_anti").join(sizes, key)
        many = rest.unionByName(keyed.join(F.broadcast(large), key))
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return (
        many.withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_a", F.least("_own", "_other"))
        .withColumn("_b", F.greatest("_own", "_other"))
        .drop("_n", "_other", "_blocks")
    )


def per_group(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on every group of ``keys``: one shuffle, one sort, many small groups in each Python call."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            if (out := work(group)) is not None and out.num_rows:
                yield out

    spread = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(each, schema)


def spanning(n: int, neighbours: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of items 0..n-1; ``neighbours(i, left)`` says which of ``left`` link to i.

    Items that are reached leave the pool, so a tight group costs about one comparison per member.
    """
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = neighbours(i, left)
            found, left = left[hit], left[~hit]
            edges.extend((int(i), int(j)) for j in found)
            queue.extend(found)
    return edges


#: A node with more than one link in so many, and ``FEW`` at least, is dealt to as many tasks as there are salts.
HOT, FEW, SALTS = 1_000, 200, 64


def with_least(links: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``links`` (u, v) with the columns of ``least`` (u, m, n), one row for each u, n of its links.

    The links of a node with many are salted, so that they meet its row in many tasks. The links' ends are some
    2 * ``n_links``, so at most 2 * ``HOT`` nodes are broadcast.
    """
    hot = F.col("n") > max(n_links // HOT, FEW)
    many = F.broadcast(least.where(hot).select("u", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = links.join(many, "u", "left").select("u", "v", salt.alias("_salt"))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.select("u", "m", F.explode(salts).alias("_salt")), ["u", "_salt"]).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until the edges form stars, each around its smallest node.
    All state stays in DataFrames; each round is checkpointed. Nulls and self links are ignored; an empty
    input gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_least(both, least, state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least, state[0])
        now = cut(small.select("u", F.col("m").alias("v")).union(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct())
