"""Scores of predictions: per-task accuracy, micro average, modes, ranks, and figures by step window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric, rules


def is_right(task: Column, gold: Column, pred: Column, open_task: str = "assistant_qa", brands: tuple[str, ...] = ()) -> Column:
    """An open task is right if the prediction answers, any other if it equals the gold text."""
    return F.when(task == open_task, rules.answers(pred, brands)).otherwise(F.coalesce(pred == gold, F.lit(False)))


def is_mode_right(task: Column, gold: Column, pred: Column, brands: tuple[str, ...] = ()) -> Column:
    """As ``is_right``, but a yes/no task is right on either word: it is the form of the answer that counts."""
    either = F.coalesce(F.lower(F.trim(pred)).isin("yes", "no"), F.lit(False))
    return F.when(task == "yesno", either).otherwise(is_right(task, gold, pred, brands=brands))


def mode(task: Column, gold: Column, pred: Column, brands: tuple[str, ...] = ()) -> Column:
    """How a prediction is counted: answer or exact if right, else its first 30 characters."""
    low = F.substring(F.lower(F.trim(pred)), 1, 30)
    return (
        F.when(task == "assistant_qa", F.when(rules.answers(pred, brands), "answer").otherwise(low))
        .when(task == "yesno", low)
        .otherwise(F.when(F.coalesce(pred == gold, F.lit(False)), "exact").otherwise(F.substring(pred, 1, 30)))
    )


def accuracy_by_task(scored: DataFrame, task: str = "task", right: str = "right") -> DataFrame:
    """(task, accuracy, n) for each task and, as "overall", for all rows: one pass with grouping sets."""
    told = scored.select(F.col(task).alias("task"), F.col(right).cast("double").alias("right")).rollup("task").agg(F.grouping("task").alias("all"), F.avg("right").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return told.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("task")).alias("task"), "accuracy", "n")


def top_modes(df: DataFrame, k: int = 5) -> DataFrame:
    """(task, mode, n, rank): the ``k`` most frequent modes of each task, ties by the mode."""
    counts = df.groupBy("task", "mode").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("n"), "mode"))).where(F.col("rank") <= k)


def rank_summary(df: DataFrame, logits: Column, target: Column) -> DataFrame:
    """(mean_rank, top1_rate, n) of the targets' ranks."""
    return df.select(numeric.target_rank(logits, target).alias("rank")).agg(F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("top1_rate"), F.count(F.lit(1)).alias("n"))


def by_step_window(df: DataFrame, step: str, ts: str, amount: Column, steps: int) -> DataFrame:
    """(window, n, amount, seconds, per_second): sums over every ``steps`` steps and the time they span."""
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    span = (F.max(stamp) - F.min(stamp)) / 1_000_000
    sums = df.groupBy(F.floor(F.col(step) / steps).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), span.alias("seconds"))
    return sums.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("amount") / F.col("seconds")))


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, iteration) of the largest iter_<n>.pt; -1 for other names, no row without files."""
    number = F.coalesce(F.expr(f"try_cast(regexp_extract({path}, 'iter_([0-9]+)[.]pt$', 1) as bigint)"), F.lit(-1))
    best = paths.select(F.col(path).alias("path"), number.alias("iteration")).agg(F.max(F.struct("iteration", "path")).alias("b")).where("b is not null")
    return best.select("b.path", "b.iteration")


def sample_table(df: DataFrame, ordinal: str, most: int, *columns: str) -> DataFrame:
    """The first ``most`` rows in order, just ``columns``: what a run logs for people to read."""
    return df.orderBy(ordinal).limit(most).select(*columns)
