"""Queries that write tables with the sinks and read them back with the readers, in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import bpe, instruct, matrices, sequence
from millrace.plans import corpus
from millrace.plans.book import Book, scratch, table
from millrace.sources import arrays, ranges, readers, shards, tensors, versions
from millrace.sources.store import file_system, remove

QUERIES = Book()
_LINES = "unnest(string_split(text, chr(10)))"


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


@QUERIES.add(f"SELECT line, count(*) AS n FROM (SELECT {_LINES} AS line FROM documents) GROUP BY line")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one a record and read again by lines."""
    path = scratch(spark, "text")
    shards.write_text(_docs(spark, sf_dir, "text"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("SELECT count(*) AS n_files, sum(n)::BIGINT AS n_lines, sum(chars)::BIGINT AS n_chars FROM (SELECT doc_id % 7, count(*) AS n, sum(length(line) + 1) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1)")
def line_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files in seven folders, newline kept, numbered within each file."""
    path = scratch(spark, "lines")
    _docs(spark, sf_dir, (F.col("doc_id") % 7).alias("part"), "text").write.partitionBy("part").text(path)  # each task its own file of a part: no shuffle
    found = readers.lines(spark, path).groupBy(F.regexp_extract("path", "part=([0-9]+)", 1).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return found.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"))


@QUERIES.add("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def separated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between end tokens, cut on record boundaries."""
    path = scratch(spark, "separated")
    _docs(spark, sf_dir, "text").write.option("lineSep", T.END).text(path)
    return readers.separated_texts(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(f"WITH {corpus._COUNTS} SELECT pretoken, freq FROM counts")
def range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens of files read in byte ranges, end tokens left out: those of the documents."""
    path = scratch(spark, "ranges")
    _docs(spark, sf_dir, "text").write.option("lineSep", T.END).text(path)
    return bpe.pretoken_counts(ranges.text_ranges(spark, path, step=64 << 10), [T.END])


_CUT_STEP = 1000


@QUERIES.add(f"""WITH f AS (SELECT doc_id % 7 AS part, string_agg(md5(text) || ' ' || coalesce(lang, '') || '  ' || n_chars || chr(10), '' ORDER BY doc_id) AS s FROM documents GROUP BY 1),
k AS (SELECT part, s, unnest(range({_CUT_STEP}, length(s), {_CUT_STEP})) AS p FROM f)
SELECT DISTINCT part, cut::BIGINT AS cut FROM (
  SELECT part, p - 1 + length(regexp_extract(s[p :], '^(.*?[^ \n\r\t])[ \n\r\t]', 1, 's')) AS cut FROM k WHERE regexp_matches(s[p :], '[^ \n\r\t][ \n\r\t]')
  UNION ALL SELECT part, p FROM k WHERE NOT regexp_matches(s[p :], '[^ \n\r\t][ \n\r\t]') UNION ALL SELECT part, 0 FROM f UNION ALL SELECT part, length(s) FROM f)""")
def split_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where seven files are cut into ranges of a thousand bytes: before the first white space of a run."""
    path = scratch(spark, "cuts")
    line = F.concat(F.md5("text"), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("  "), F.col("n_chars").cast("string"))
    lines = _docs(spark, sf_dir, (F.col("doc_id") % 7).alias("part"), "doc_id", line.alias("line"))
    lines.repartitionById(7, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id").select("part", "line").write.partitionBy("part").text(path)
    return ranges.cut_points(spark, path, _CUT_STEP).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "cut")


@QUERIES.add("SELECT part, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM (SELECT doc_id % 5 AS part, text FROM documents) GROUP BY part")
def bytes_ignoring_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files in whose end an invalid byte is dropped."""
    path = scratch(spark, "bytes")
    _docs(spark, sf_dir, (F.col("doc_id") % 5).alias("part"), "text").write.partitionBy("part").text(path)  # each task its own file of a part: no shuffle
    found = readers.texts_ignoring_errors(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), F.octet_length("text").alias("n"))
    return found.groupBy("part").agg(F.sum("n").alias("n_bytes")).where("n_bytes > 0")


@QUERIES.add("SELECT (doc_id % 6)::INTEGER AS file_idx, CASE WHEN doc_id % 6 < 4 THEN 'train' ELSE 'valid' END AS split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def split_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet texts of files in the order of their paths; the first four files train, and one of another suffix is not read."""
    path = scratch(spark, "files")
    docs = _docs(spark, sf_dir, (F.col("doc_id") % 6).alias("file"), "doc_id", "text").repartitionById(6, F.col("file").cast("int"))  # a file a task; by hash some tasks would write several
    docs.write.partitionBy("file").parquet(path)
    docs.where("doc_id % 600 = 0").coalesce(1).drop("file").write.parquet(f"{path}/file=0/_more")  # one small file
    fs, more = file_system(spark, f"{path}/file=0/_more")
    name = next(s.getPath() for s in fs.listStatus(more) if s.getPath().getName().startswith("part-"))
    fs.rename(name, file_system(spark, f"{path}/file=0/again.parquet.parquet")[1])
    remove(spark, f"{path}/file=0/_more")
    return readers.split_by_file(readers.parquet_texts(spark, path), 4).groupBy("file_idx", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


_JSON = "doc_id long, text string, lang string, n_chars long"


@QUERIES.add("SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def strict_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "strict")
    _docs(spark, sf_dir, "doc_id", "text", "lang", "n_chars").write.json(path)
    return readers.strict_jsonl(spark, path, _JSON).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@QUERIES.add("SELECT i AS instruction, md5(o) AS output_md5, task, count(*) AS n FROM (SELECT 'Say ' || doc_id AS i, regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g') AS o, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS task FROM documents WHERE doc_id % 4 <> 0) GROUP BY ALL")
def tolerant_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth line is broken, each fifth task is null, and blank lines lie between."""
    path = scratch(spark, "tolerant")
    row = F.to_json(F.struct(F.concat(F.lit("Say "), "doc_id").alias("instruction"), F.col("text").alias("output"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("task"), F.lit(1).alias("more")))
    broken = F.when(F.col("doc_id") % 4 == 0, F.substring(row, 1, 12)).otherwise(row)
    _docs(spark, sf_dir, F.explode(F.array(broken, F.lit("  "))).alias("value")).write.text(path)
    found = readers.tolerant_jsonl(spark, path)
    return found.groupBy("instruction", F.md5("output").alias("output_md5"), "task").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold one JSON array each, of a hundred documents."""
    path = scratch(spark, "array")
    packed = _docs(spark, sf_dir, F.floor(F.col("doc_id") / 100).alias("part"), F.struct("doc_id", "text").alias("d")).groupBy("part").agg(F.to_json(F.collect_list("d")).alias("value"))
    packed.repartition(packed.count() or 1, "part").write.partitionBy("part").text(path)
    return readers.json_array(spark, f"{path}/part=*", "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


@QUERIES.add("SELECT 'img/' || doc_id || '.jpg' AS fn, CASE doc_id % 3 WHEN 0 THEN 'train' ELSE 'test' END AS split, caption_index, output FROM (SELECT doc_id, 0 AS caption_index, 'A text in ' || lang AS output FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 1, n_chars || ' characters, \"all\" told' FROM documents WHERE doc_id % 3 < 2) WHERE output IS NOT NULL")
def caption_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a JSON list in a cell, quotes and commas inside; a third split is not asked for."""
    path = scratch(spark, "captions")
    raw = F.to_json(F.array(F.concat(F.lit("A text in "), F.coalesce("lang", F.lit(""))), F.concat(F.col("n_chars").cast("string"), F.lit(' characters, "all" told')), F.lit(" ")))
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "test").otherwise("spare")
    _docs(spark, sf_dir, raw.alias("raw"), split.alias("split"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("doc_id").cast("string").alias("img_id")).write.csv(path, header=True, quote='"', escape='"')
    return readers.captions(spark, path, "img").select("fn", "split", "caption_index", "output")


@QUERIES.add("SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'valid' END AS split FROM documents) GROUP BY split")
def split_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tagged train stay so, all other tags are validation."""
    tag = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return readers.split_by_column(_docs(spark, sf_dir, tag.alias("tag")), "tag").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.byte_ids(F.col("text"))
    return _docs(spark, sf_dir, F.when(F.col("doc_id") % 10 == 0, "valid").otherwise("train").alias("split"), F.floor(F.col("doc_id") / 256).cast("int").alias("shard_id"), F.col("doc_id").alias("seq_no"), ids.alias("token_ids"))


_SHARDS = "SELECT CASE WHEN doc_id % 10 = 0 THEN 'valid' ELSE 'train' END AS split, (doc_id // 256)::INTEGER AS shard_id, sum(strlen(text))::BIGINT AS n_tokens FROM documents GROUP BY 1, 2"


@QUERIES.add(_SHARDS)
def shard_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards written a folder each and read back."""
    path = scratch(spark, "shards")
    shards.write_shards(_stream(spark, sf_dir), path)
    return shards.read_shards(spark, path).groupBy("split", F.col("shard_id").cast("int").alias("shard_id")).agg(F.sum(F.size("token_ids")).cast("long").alias("n_tokens"))


@QUERIES.add(_SHARDS)
def npy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shards as array files."""
    path = scratch(spark, "npy")
    arrays.write_npy(_stream(spark, sf_dir), path, 256)
    return arrays.read_npy(spark, path).groupBy("split", "shard_id").agg(F.sum(F.size("token_ids")).cast("long").alias("n_tokens"))


@QUERIES.add("""WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'valid' ELSE 'train' END AS split, (doc_id // 256)::INTEGER AS shard_id, string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents GROUP BY 1, 2)
SELECT split, shard_id, start, md5(h[2 * start + 1 : 2 * start + 8192]) AS ids_md5 FROM (SELECT *, unnest(range(0, length(h) // 2, 4096)) AS start FROM s)""")
def array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array files read in rows of 4,096 tokens, four rows a task."""
    path = scratch(spark, "arrays")
    arrays.write_npy(_stream(spark, sf_dir), path, 70_000)
    code = F.md5(F.array_join(F.transform("token_ids", lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    return arrays.read_npy(spark, path, 4 * 4096, 4096).select("split", "shard_id", "start", code.alias("ids_md5"))


@QUERIES.add("SELECT doc_id, n_chars FROM documents WHERE n_chars > 100")
def jsonl_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is rewritten from its own rows."""
    path = scratch(spark, "rewritten")
    shards.overwrite_jsonl(_docs(spark, sf_dir, "doc_id", "n_chars"), path)
    shards.overwrite_jsonl(spark.read.schema("doc_id long, n_chars long").json(path).where("n_chars > 100"), path)
    return spark.read.schema("doc_id long, n_chars long").json(path)


@QUERIES.add("SELECT 'r' AS run, event_id // 1000 AS step, metric, value FROM (SELECT event_id // 1000 * 1000 AS event_id, 'n' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT event_id // 1000 * 1000, 'users', count(DISTINCT user_id)::DOUBLE FROM events GROUP BY 1)")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by step in long form, appended and read back."""
    path = scratch(spark, "metrics")
    wide = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("step")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("user_id").cast("double").alias("users"))
    wide.unpivot("step", ["n", "users"], "metric", "value").select(F.lit("r").alias("run"), "step", "metric", "value").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@QUERIES.add("SELECT doc_id, source_order, lang FROM (SELECT doc_id, 0 AS source_order, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, lang FROM documents WHERE doc_id % 3 = 0)")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "lang")
    return instruct.ordered_union(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"))


@QUERIES.add("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.1) THEN 'val' ELSE 'train' END AS split FROM documents")
def head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.head_split(_docs(spark, sf_dir, "doc_id"), "doc_id", 0.1)


@QUERIES.add("SELECT doc_id, task FROM (SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 <> 0 THEN ' ' || lang END), ''), 'unknown') AS task FROM documents) WHERE task IN ('en', 'fr', 'unknown')")
def task_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are null or blank count as unknown."""
    task = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 7 != 0, F.concat(F.lit(" "), "lang"))
    return instruct.of_tasks(_docs(spark, sf_dir, "doc_id", task.alias("task")), "task", ["en", "fr", "unknown"])


@QUERIES.add("SELECT doc_id, (trim(split_part(text || '<|endoftext|>' || lang, '<|endoftext|>', 1), ' \n\t\r\x0b\x0c')) AS answer FROM (SELECT doc_id, n_chars || ' of ' || lang AS text, lang FROM documents)")
def until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first end token."""
    told = F.concat(F.col("n_chars").cast("string"), F.lit(" of "), "lang", F.lit(T.END), "lang")
    return _docs(spark, sf_dir, "doc_id", T.until_end(told).alias("answer"))


_PART = corpus._PIECES.replace("regexp_replace(text,", "regexp_replace(part,")


@QUERIES.add(f"SELECT pretoken, count(*) AS freq FROM (SELECT unnest({_PART}) AS pretoken FROM (SELECT unnest([coalesce(lang, ''), source || ' ' || n_chars || '  ', coalesce(lang, '') || ', it''s ' || doc_id]) AS part FROM documents)) GROUP BY pretoken")
def specials_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training counts leave special tokens out: the pieces between them."""
    lang = F.coalesce("lang", F.lit(""))
    text = F.concat(lang, F.lit("<|a|>"), "source", F.lit(" "), F.col("n_chars").cast("string"), F.lit("  <|b|>"), lang, F.lit(", it's "), F.col("doc_id").cast("string"))
    return bpe.pretoken_counts(_docs(spark, sf_dir, text.alias("text")), ["<|a|>", "<|b|>"])


@QUERIES.add("SELECT doc_id, array_to_string(list_transform(range(greatest(1, strlen(text) - 15), strlen(text) + 1), lambda i: ('0x' || hex(encode(text))[2 * i - 1 : 2 * i])::INTEGER), ',') AS last FROM documents")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sixteen tokens of each text."""
    rows = _docs(spark, sf_dir, "doc_id", bpe.byte_ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.array_join(sequence.last_tokens(F.col("ids"), 16).cast("array<string>"), ",").alias("last"))


_TABLE = "SELECT vec_id AS token, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings"


@QUERIES.add(f"WITH e AS ({_TABLE}), i AS (SELECT doc_id, p AS position, (doc_id * 7 + p * 13) % 600 AS token FROM documents, range(4) t(p)) SELECT doc_id, position, token, vector[1] AS first, vector[64] AS last FROM i LEFT JOIN e USING (token)")
def embedding_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of four tokens of each document; a token that the table lacks has none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    at = _docs(spark, sf_dir, "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("position"))
    ids = at.withColumn("token", (F.col("doc_id") * 7 + F.col("position") * 13) % 600)
    return matrices.gather(ids, vectors).select("doc_id", "position", "token", F.get("vector", F.lit(0)).alias("first"), F.get("vector", F.lit(63)).alias("last"))


@QUERIES.add("SELECT round(norm, 6) AS norm, round(CASE WHEN norm >= 1 THEN 1 / (norm + 1e-6) ELSE 1.0 END, 9) AS factor FROM (SELECT sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS norm FROM embeddings)")
def global_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm of all vectors taken as one gradient, and the factor that clips it to 1."""
    v = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return matrices.clipped(v, 1.0).select(F.round("norm", 6).alias("norm"), F.round("factor", 9).alias("factor"))


@QUERIES.add("SELECT doc_id, caption_index, doc_id % 20 = 0 AS found FROM documents, range(2) t(caption_index)")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with and without a file in a store, which holds one for each twentieth document."""
    path = scratch(spark, "images")
    stored = _docs(spark, sf_dir, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), F.col("source").alias("value")).where("image like '%0.jpg'")
    stored.where(F.substring_index("image", ".", 1).cast("long") % 20 == 0).write.partitionBy("image").text(path)
    files = readers.listing(spark, path, "part-*").withColumn("image", F.regexp_extract("path", "image=([^/]+)/", 1))
    rows = _docs(spark, sf_dir, "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("caption_index"))
    both = readers.with_files(rows, files, "image", "image").withColumn("found", F.lit(True)).unionByName(readers.without_files(rows, files, "image", "image").withColumn("found", F.lit(False)))
    return both.select("doc_id", "caption_index", "found")


@QUERIES.add("SELECT doc_id, n_chars, 2::BIGINT AS version, 2 AS n_kept FROM documents")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table, each with more rows; the last two are kept and the last is read."""
    path = scratch(spark, "versions")
    for part in range(3):
        number = versions.commit(_docs(spark, sf_dir, "doc_id", "n_chars").where(F.col("doc_id") % 3 <= part), path, 2)
    return versions.read_latest(spark, path).withColumn("version", F.lit(number).cast("long")).withColumn("n_kept", F.lit(len(versions.versions(spark, path))))


def _tensors(spark: SparkSession, sf_dir: str) -> str:
    """A file for each ten labels' vectors: a matrix of the label's rows, and its first two rows as an adapter's part."""
    path = scratch(spark, "tensors")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = e.withColumn("row", rank).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    file, name = F.concat(F.lit("part"), (F.col("label") % 3).cast("string")), F.concat(F.lit("model.layer"), F.col("label").cast("string"))
    shaped = lambda n: F.array(n.cast("long"), F.lit(64).cast("long")).alias("shape")
    whole = rows.select(file.alias("file"), F.concat(name, F.lit(".weight")).alias("name"), shaped(F.col("n")), (F.col("row") * 64).cast("long").alias("start"), "values")
    part = rows.where("row < 2").select(file.alias("file"), F.concat(name, F.when(F.col("label") % 2 == 0, ".A").otherwise(".B")).alias("name"), shaped(F.least("n", F.lit(2))), (F.col("row") * 64).cast("long").alias("start"), "values")
    tensors.write_tensors(whole.union(part), path)
    return path


_LABELLED = "r AS (SELECT label, embedding, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row FROM embeddings)"


@QUERIES.add(f"""WITH {_LABELLED}, u AS (SELECT 'layer' || label || '.weight' AS name, row * 64 + unnest(range(64)) AS spot, unnest(embedding)::DOUBLE AS v FROM r
UNION ALL SELECT 'layer' || label || CASE WHEN label % 2 = 0 THEN '.A' ELSE '.B' END, row * 64 + unnest(range(64)), unnest(embedding)::DOUBLE FROM r WHERE row < 2)
SELECT name, spot // 100 * 100 AS start, count(*)::INTEGER AS n, round(sum(v), 6) + 0.0 AS total FROM u GROUP BY 1, 2""")
def tensor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors written by the executors and read in blocks of a hundred values; names lose the module they belong to."""
    found = tensors.read_tensors(spark, _tensors(spark, sf_dir), 100)
    bare = F.regexp_replace("name", "^model[.]", "")
    return found.select(bare.alias("name"), "start", F.size("values").alias("n"), (F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


@QUERIES.add(f"WITH {_LABELLED}, c AS (SELECT label, count(*) * 64 AS whole, least(count(*), 2) * 64 AS part FROM r GROUP BY label) SELECT (sum(whole) + sum(part))::BIGINT AS total, sum(part)::BIGINT AS trainable, round(100 * sum(part) / (sum(whole) + sum(part)), 9) AS percent FROM c")
def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in all, those of adapters and their share, from the files' headers."""
    headers = tensors.read_tensors(spark, _tensors(spark, sf_dir), values=False)
    return tensors.parameter_counts(headers, tensors.is_adapter(F.col("name"))).withColumn("percent", F.round("percent", 9))


@QUERIES.add("""WITH r AS (SELECT doc_id AS ordinal, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN page_id || '.png' WHEN 2 THEN 'none.png' ELSE page_id || '.png' END AS image, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS text,
  doc_id % 97 = 96 AND doc_id * 10 > (SELECT 9 * max(doc_id) FROM documents) AS ends FROM documents LEFT JOIN pages ON page_id = doc_id)
SELECT ordinal, coalesce(image, '') AS image, text FROM r WHERE text <> '' AND ordinal < coalesce((SELECT min(ordinal) FROM r WHERE ends), ordinal + 1) AND image IS NOT NULL AND image <> 'none.png'""")
def prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over documents until one says quit; the pages' ids name the images that there are."""
    d, name = F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    most = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    image = F.when((d % 97 == 96) & (d * 10 > 9 * most), " QUIT ").when(d % 4 == 0, "  ").when(d % 4 == 1, F.concat(F.lit(' "'), name, F.lit('" '))).when(d % 4 == 2, "none.png").otherwise(F.concat(F.lit("'"), name, F.lit("'")))
    rows = _docs(spark, sf_dir, d.alias("ordinal"), image.alias("image"), F.when(d % 6 == 0, " \n").otherwise(F.concat(F.lit(" "), "source")).alias("text"))
    images = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("name"))
    return readers.prompts(rows, images)
