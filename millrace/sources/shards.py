"""Token shards as Parquet tables partitioned by split and shard, vocabularies, and files of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.bpe import Encoder


def write_shards(tokens: DataFrame, path: str) -> None:
    """Tokens (split, shard_id, seq_no, token_ids) in a directory per split and shard, rows in order."""
    tokens.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "seq_no").write.mode("overwrite").partitionBy("split", "shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vocabulary_table(spark: SparkSession, tokens: list[bytes]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(bytearray, tokens))), "token_id int, token binary")


def merge_table(spark: SparkSession, merges: list[tuple[int, int, int]], tokens: list[bytes]) -> DataFrame:
    """(rank, left, right, merged_id)."""
    rows = [(rank, bytearray(tokens[a]), bytearray(tokens[b]), 256 + rank) for rank, (a, b, *_) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left binary, right binary, merged_id int")


def write_vocabulary(spark: SparkSession, tokens: list[bytes], merges: list[tuple[int, int, int]], path: str) -> None:
    """A vocabulary and its merges as two tables below ``path``; both are as small as the model."""
    vocabulary_table(spark, tokens).write.parquet(f"{path}/vocabulary")
    merge_table(spark, merges, tokens).write.parquet(f"{path}/merges")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, merges) as ``write_vocabulary`` leaves them."""
    vocab = spark.read.schema("token_id int, token binary").parquet(f"{path}/vocabulary")
    return vocab, spark.read.schema("rank int, left binary, right binary, merged_id int").parquet(f"{path}/merges")


def encoder_of(vocab: DataFrame, merges: DataFrame, specials: Sequence[str] = ()) -> Encoder:
    """An encoder from the two tables, merges that the vocabulary does not hold left out."""
    tokens = [bytes(r.token) for r in vocab.orderBy("token_id").collect()]
    pairs = [(r.left_id, r.right_id) for r in known_merges(merges, vocab).orderBy("rank").collect()]
    return Encoder(tokens, pairs, specials)


def known_merges(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rank, left_id, right_id, merged_id) of the merges whose parts and result are all in the vocabulary."""
    token = lambda name: vocab.groupBy(F.col("token").alias(name)).agg(F.max("token_id").alias(f"{name}_id"))
    whole = merges.select("rank", "left", "right", F.concat("left", "right").alias("merged"))
    return whole.join(token("left"), "left").join(token("right"), "right").join(token("merged"), "merged").select("rank", "left_id", "right_id", "merged_id")


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """``df`` as JSON lines at ``path``, even if it reads from there.

    Written beside it first; the old files are moved aside before the new ones take their place and deleted last, so
    that either is whole at every moment. A run that broke off between the moves is put right by the next one.
    """
    spark, aside, old = df.sparkSession, f"{path}.next", f"{path}.old"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    df.write.mode("overwrite").json(aside)
    if fs.exists(fs_path(path)):
        fs.delete(fs_path(old), True)
        if not fs.rename(fs_path(path), fs_path(old)):
            raise OSError(f"cannot move {path} to {old}")
    if not fs.rename(fs_path(aside), fs_path(path)):
        raise OSError(f"cannot move {aside} to {path}")
    fs.delete(fs_path(old), True)


def write_text(docs: DataFrame, path: str) -> None:
    """One document and a newline per record; a document with newlines becomes several lines."""
    docs.select("text").write.mode("overwrite").text(path)


def metrics(run: str, step: int, values: dict[str, float], spark: SparkSession) -> DataFrame:
    """(run, step, metric, value) rows of one step."""
    return spark.createDataFrame([(run, step, k, float(v)) for k, v in sorted(values.items())], "run string, step long, metric string, value double")
