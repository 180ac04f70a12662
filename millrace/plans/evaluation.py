"""Queries that score predictions. The assistant's turns stand for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import evaluation, instruct
from millrace.plans.book import Book, scratch, table
from millrace.plans.instruction import _PAIRS, _any

QUERIES = Book()

_PREDS = f"""{_PAIRS}, preds AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'assistant_qa' WHEN 1 THEN 'yesno' ELSE 'copy' END AS task, output AS gold,
  CASE WHEN conv_id % 3 = 1 THEN (CASE turn % 4 WHEN 0 THEN 'Yes' ELSE 'no' END) WHEN conv_id % 3 = 2 AND turn % 4 <> 0 THEN '! ' || output WHEN conv_id % 9 = 0 THEN 'Sorry, ' || output ELSE output END AS pred FROM pairs),
scored AS (SELECT *, CASE WHEN task = 'assistant_qa' THEN answers ELSE pred = gold END AS "right", CASE WHEN task = 'assistant_qa' THEN answers WHEN task = 'yesno' THEN lower(trim(pred)) IN ('yes', 'no') ELSE pred = gold END AS mode_right,
  CASE WHEN task = 'assistant_qa' THEN (CASE WHEN answers THEN 'answer' ELSE lower(trim(pred))[1:30] END) WHEN task = 'yesno' THEN lower(trim(pred))[1:30] WHEN pred = gold THEN 'exact' ELSE pred[1:30] END AS mode
  FROM (SELECT *, n BETWEEN 1 AND 80 AND NOT regexp_replace(lower(w[1]), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') IN ('yes', 'no') AND NOT {_any('lower(pred)', rules.MODE_REFUSALS)} AS answers
    FROM (SELECT *, len(w) AS n FROM (SELECT *, regexp_extract_all(pred, '\\S+') AS w FROM preds))))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = instruct.turn_pairs(table(spark, sf_dir, "conversations"))
    third = F.col("conv_id") % 3
    task = F.when(third == 0, "assistant_qa").when(third == 1, "yesno").otherwise("copy")
    pred = (
        F.when(third == 1, F.when(F.col("turn") % 4 == 0, "Yes").otherwise("no"))
        .when((third == 2) & (F.col("turn") % 4 != 0), F.concat(F.lit("! "), "output"))
        .when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Sorry, "), "output"))
        .otherwise(F.col("output"))
    )
    return pairs.select("conv_id", "turn", task.alias("task"), F.col("output").alias("gold"), pred.alias("pred"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = F.col("task"), F.col("gold"), F.col("pred")
    return predictions(spark, sf_dir).select("conv_id", "turn", "task", evaluation.is_right(*columns).alias("right"), evaluation.is_mode_right(*columns).alias("mode_right"), evaluation.mode(*columns).alias("mode"))


@QUERIES.add(f'WITH {_PREDS} SELECT conv_id, turn, task, "right", mode_right, mode FROM scored')
def mode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@QUERIES.add(f"""WITH {_PREDS} SELECT coalesce(task, 'overall') AS task, round(avg("right"::INTEGER), 9) AS accuracy, count(*) AS n FROM scored GROUP BY ROLLUP (task)""")
def mode_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy_by_task(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@QUERIES.add(f"""WITH {_PREDS} SELECT coalesce(task, 'overall') AS task, round(avg(mode_right::INTEGER), 9) AS accuracy, count(*) AS n FROM scored GROUP BY ROLLUP (task)""")
def mode_form_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy where a yes/no task is right on either word."""
    return evaluation.accuracy_by_task(_scored(spark, sf_dir), right="mode_right").withColumn("accuracy", F.round("accuracy", 9))


@QUERIES.add(f"WITH {_PREDS} SELECT conv_id, turn, task, gold, pred FROM preds ORDER BY conv_id * 1000 + turn LIMIT 8")
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight scored rows, written as a run's sample table and read back."""
    path = scratch(spark, "samples")
    rows = predictions(spark, sf_dir).withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    evaluation.sample_table(rows, "place", 8, "conv_id", "turn", "task", "gold", "pred").write.parquet(path)
    return spark.read.parquet(path)


@QUERIES.add(f"WITH {_PREDS} SELECT task, mode, n, rank FROM (SELECT task, mode, count(*) AS n, row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, encode(mode))::INTEGER AS rank FROM scored GROUP BY task, mode) WHERE rank <= 5")
def top_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_modes(_scored(spark, sf_dir))


@QUERIES.add("SELECT coalesce(task, 'overall') AS task, round(avg(ok), 9) AS accuracy, count(*) AS n FROM (SELECT lang AS task, ((n_chars > 300) = (quality = 1))::INTEGER AS ok FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (task)")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = joined.select(F.col("lang").alias("task"), ((F.col("n_chars") > 300) == (F.col("quality") == 1)).alias("right"))
    return evaluation.accuracy_by_task(scored).withColumn("accuracy", F.round("accuracy", 9))


@QUERIES.add('SELECT w AS "window", n, round(amount, 4) AS amount, round(seconds, 4) AS seconds, CASE WHEN seconds > 0 THEN round(amount / seconds, 6) END AS per_second FROM (SELECT event_id // 50 AS w, count(*) AS n, sum(value) AS amount, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS seconds FROM events GROUP BY 1)')
def throughput_by_step_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = evaluation.by_step_window(table(spark, sf_dir, "events"), "event_id", "ts", F.col("value"), 50)
    return sums.select("window", "n", F.round("amount", 4).alias("amount"), F.round("seconds", 4).alias("seconds"), F.round("per_second", 6).alias("per_second"))


@QUERIES.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension beyond the reference: event-time windows."""
    from millrace.streaming.dedup import events_by_window as windows

    return windows(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))
