"""Readers. All but ``texts_ignoring_errors`` go through Spark's own file sources, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import END, answer_items, one_line, strip
from millrace.sources import ranges

PAIR = "instruction string, output string, task string"


def file_number(df: DataFrame) -> DataFrame:
    """``df`` with ``path`` and ``file_idx``, the 0-based place of the file among the sorted paths."""
    found = df.withColumn("path", F.col("_metadata.file_path"))
    paths = found.select("path").distinct().withColumn("file_idx", F.row_number().over(Window.orderBy("path")) - 1)
    return found.join(paths, "path")  # one row per file


def parquet_texts(spark: SparkSession, path: str, excluded: str = ".parquet.parquet") -> DataFrame:
    """(path, file_idx, text) of the Parquet files below ``path`` whose names do not end in ``excluded``; one column is read."""
    files = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).where(~F.col("_metadata.file_name").endswith(excluded))
    return file_number(files).select("path", "file_idx", "text")


def split_by_file(df: DataFrame, train_files: int = 450) -> DataFrame:
    """``df`` with ``split``: the first ``train_files`` files are for training, the rest for validation."""
    return df.withColumn("split", F.when(F.col("file_idx") < train_files, "train").otherwise("valid"))


def split_by_column(df: DataFrame, tag: str, train: str = "train") -> DataFrame:
    """``df`` with ``split``: rows tagged ``train`` are for training, those with any other tag for validation."""
    return df.withColumn("split", F.when(F.col(tag) == train, "train").otherwise("valid"))


def lines(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """(path, line_no, text) of text files, the newline kept; the first ``limit`` lines by path and place, all if negative.

    Lines are numbered where they are read: within a split by their place, after the lines of the file's earlier splits, which a
    table of a row a split tells. A large file is as many tasks as it has splits.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.concat("value", F.lit("\n")).alias("text"))
    splits = rows.groupBy("path", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = rows.join(splits, ["path", "split"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "text")
    return numbered if limit < 0 else numbered.orderBy("path", "line_no").limit(limit)


def separated_texts(spark: SparkSession, path: str, separator: str = END) -> DataFrame:
    """(text) of the documents between separators; Spark plans the splits on record boundaries."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("value").alias("text")).where("text <> ''")


def texts_ignoring_errors(spark: SparkSession, path: str, step: int = ranges.STEP) -> DataFrame:
    """(path, start, text) of whole files with invalid UTF-8 bytes dropped, a row for each ``step`` bytes of a file.

    A file is read in byte ranges that end before white space or a character, so no task holds a large file and the rows of a file in the
    order of ``start`` are its text. Files up to ``step`` bytes are one row.
    """
    return ranges.text_ranges(spark, path, step).select("path", "start", "text")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """Rows of JSON lines; blank lines and lines that are not objects are skipped, texts are stripped, null is empty."""
    return tolerant_json(spark.read.text(path), schema)


def tolerant_json(raw: DataFrame, schema: str = PAIR, column: str = "value") -> DataFrame:
    clean = F.trim(F.col(column))
    parsed = raw.where(clean.startswith("{")).select(F.from_json(clean, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row")).where("row is not null and row._bad is null").select("row.*").drop("_bad")
    return parsed.select(*[F.coalesce(strip(F.col(n)), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in parsed.dtypes])


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a bad line ends the query with an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def captions(spark: SparkSession, path: str, image_dir: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(fn, filename, img_id, split, caption_index, output) of a CSV file whose column raw is a JSON list of captions."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return caption_rows(rows, image_dir, splits)


def caption_rows(rows: DataFrame, image_dir: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    named = rows.select(F.trim("filename").alias("filename"), F.trim("split").alias("split"), F.trim(F.coalesce("img_id", F.lit(""))).alias("img_id"), F.from_json("raw", "array<string>").alias("raw"))
    each = named.where((F.col("filename") != "") & F.col("split").isin(*splits)).select("*", F.posexplode("raw").alias("caption_index", "caption"))
    return each.select(F.concat_ws("/", F.lit(image_dir), "filename").alias("fn"), "filename", "img_id", "split", "caption_index", strip(F.col("caption")).alias("output")).where("output <> ''")


def prompts(rows: DataFrame, images: DataFrame, ends: Sequence[str] = ("exit", "quit")) -> DataFrame:
    """(ordinal, image, text) of prompts (ordinal, image, text) in order up to the first whose image is a word of ``ends``.

    Texts and images are stripped, quotes around an image too; a blank text is skipped, and so is an image that is not among
    ``images`` (name). A blank image is none. What ends the prompts is one number, so nothing is sorted.
    """
    clean = rows.select("ordinal", strip(F.coalesce("image", F.lit(""))).alias("image"), strip(F.coalesce("text", F.lit(""))).alias("text"))
    last = clean.where(F.lower("image").isin(*ends)).agg(F.min("ordinal").alias("_last"))
    bare = F.regexp_replace(F.regexp_replace("image", '^"+|"+$', ""), "^'+|'+$", "")
    asked = clean.join(F.broadcast(last), F.col("_last").isNull() | (F.col("ordinal") < F.col("_last"))).where("text <> ''").select("ordinal", bare.alias("image"), "text")  # one row
    none = asked.where("image = ''")
    return none.unionByName(with_files(asked.where("image <> ''"), images, "image").select("ordinal", "image", "text"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size) of the files below ``path``. Listing is Spark's own, in parallel for many folders; no file is opened,
    and an empty one is not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def with_files(rows: DataFrame, files: DataFrame, name: str, file: str = "name") -> DataFrame:
    """Rows whose ``name`` is a file of the listing; ``without_files`` has the others."""
    return rows.join(files.select(F.col(file).alias(name)).distinct(), name, "left_semi")


def without_files(rows: DataFrame, files: DataFrame, name: str, file: str = "name") -> DataFrame:
    """Rows whose ``name`` is null or no file of the listing."""
    return rows.join(files.select(F.col(file).alias(name)).distinct(), name, "left_anti")


def requests(spark: SparkSession, jobs: int, prompts: Sequence[str], per_job: int, first: int = 0) -> DataFrame:
    """(job, prompt): job i asks prompt i modulo their number, {n} filled in."""
    listed = F.array(*[F.lit(p.replace("{n}", str(per_job))) for p in prompts])
    return spark.range(first, first + jobs).select(F.col("id").alias("job"), F.get(listed, F.pmod("id", F.lit(len(prompts))).cast("int")).alias("prompt"))


def completions(asked: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """(job, answer): ``client`` called on the executors; a failed call gives a null answer."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                try:
                    answers.append(client(prompt))
                except Exception:  # noqa: BLE001  any failure of a remote service counts as no answer
                    answers.append(None)
            yield pd.DataFrame({"job": batch["job"], "answer": answers})

    return asked.select("job", "prompt").mapInPandas(each, "job long, answer string")


def answered_pairs(answers: DataFrame) -> DataFrame:
    """(ordinal, instruction, output) of the items in JSON answers (job, answer), in the order of jobs and items."""
    items = answers.select("job", F.posexplode(answer_items(F.col("answer"))).alias("at", "item"))
    return items.select((F.col("job") * 1_000_000 + F.col("at")).alias("ordinal"), one_line(F.coalesce("item.instruction", F.lit(""))).alias("instruction"), one_line(F.coalesce("item.output", F.lit(""))).alias("output"))
