"""Queries over documents: lines, pre-tokens, BPE, token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import bpe, instruct, merges, sequence
from millrace.plans.book import Book, scratch, spread, table

QUERIES = Book()
VOCABULARY, MIN_FREQ, BLOCK, SHARD, BATCH = 600, 5, 256, 50_000, 64
MERGES = VOCABULARY - 256 - 1  # bytes and the end token take the other places

#: DuckDB's patterns have no look-ahead: a mark before the last white space of a run stands for it.
_PIECES = r"""regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(57344) || '\2', 'g'), '''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x{E000}]+|\s+')"""
_COUNTS = f"counts AS (SELECT pretoken, count(*) AS freq FROM (SELECT unnest({_PIECES}) AS pretoken FROM documents) GROUP BY pretoken)"
_LISTED = "array_to_string(list_transform(range(1, strlen({0}) // 2 + 1), lambda i: ('0x' || {0}[2 * i - 1 : 2 * i])::INTEGER), ',')"
_TAGGED = "array_to_string(list_transform(range(1, strlen({0}) + 1), lambda i: '<' || ('0x' || hex(encode({0}))[2 * i - 1 : 2 * i])::INTEGER || '>'), '')"


def _pairs(words: str) -> str:
    return f"SELECT u.l AS l, u.r AS r, sum(freq) AS n FROM (SELECT unnest(list_transform(range(1, len(ids)), lambda i: {{'l': ids[i], 'r': ids[i + 1]}})) AS u, freq FROM (SELECT list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: x::INTEGER) AS ids, freq FROM {words})) GROUP BY 1, 2"


_WORDS = f"{_COUNTS}, w0 AS (SELECT {_TAGGED.format('pretoken')} AS s, freq FROM counts)"
#: Rows of step k hold the words after k merges, as <id><id>, and the merge that made them.
_TRAINED = f"""{_COUNTS}, train AS (SELECT 0 AS k, {_TAGGED.format('pretoken')} AS s, freq, NULL::INTEGER AS l, NULL::INTEGER AS r, NULL::BIGINT AS n FROM counts WHERE freq >= {MIN_FREQ}
  UNION ALL SELECT t.k + 1, replace(t.s, '<' || b.l || '><' || b.r || '>', '<' || (256 + t.k) || '>'), t.freq, b.l, b.r, b.n
  FROM train t, (SELECT l, r, n::BIGINT AS n FROM ({_pairs('train')}) ORDER BY n DESC, l DESC, r DESC LIMIT 1) b WHERE t.k < {MERGES} AND contains(t.s, '><')),
merges AS MATERIALIZED (SELECT DISTINCT k - 1 AS rank, l, r, n FROM train WHERE k > 0)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(ids: str) -> Column:
    """A hash of the ids, joined by commas; casts and joins stay in generated code."""
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ","))


@QUERIES.add(f"WITH {_COUNTS} SELECT pretoken, freq FROM counts")
def pretoken_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pretoken_counts(spread(_documents(spark, sf_dir).select("text")))


@QUERIES.add(f"WITH {_COUNTS} SELECT pretoken, freq FROM counts WHERE freq >= 5")
def pretoken_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.frequent(bpe.pretoken_counts(_documents(spark, sf_dir)), min_freq=5)


@QUERIES.add(f"WITH {_COUNTS} SELECT pretoken, freq FROM counts ORDER BY freq DESC, encode(pretoken) LIMIT 1000")
def pretoken_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.frequent(bpe.pretoken_counts(_documents(spark, sf_dir)), most=1000)


@QUERIES.add("SELECT doc_id, (i - 1)::INTEGER AS line_no, parts[i] || chr(10) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "part"))
    return split.select("doc_id", "line_no", F.concat("part", F.lit("\n")).alias("line"))


@QUERIES.add("SELECT doc_id, (i - 1)::INTEGER AS line_no, parts[i] || chr(10) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) ORDER BY doc_id, line_no LIMIT 500")
def line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_lines(spark, sf_dir).orderBy("doc_id", "line_no").limit(500)


@QUERIES.add("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 450 THEN 'train' ELSE 'valid' END AS split FROM documents")
def train_valid_split_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sequence.running_sum(_documents(spark, sf_dir).select("doc_id", F.lit(1).alias("one")), "one", "doc_id", "place")
    return placed.select("doc_id", F.when(F.col("place") < 450, "train").otherwise("valid").alias("split"))


@QUERIES.add("SELECT byte, count(*) AS n FROM (SELECT unnest(list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || hex(encode(text))[2 * i - 1 : 2 * i])::INTEGER)) AS byte FROM (SELECT unnest(string_split(text, ' ')) || ' ' AS text FROM documents)) GROUP BY byte UNION ALL SELECT -1, count(*) FROM documents")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all texts, each followed by a space; byte -1 counts the texts, so that the spaces can be taken off."""
    docs = _documents(spark, sf_dir)
    bytes_ = docs.select(F.explode(T.utf8_bytes(F.concat("text", F.lit(" ")))).alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))
    return bytes_.union(docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("byte"), "n"))


@QUERIES.add(f"WITH {_WORDS} SELECT l AS \"left\", r AS \"right\", n::BIGINT AS n FROM ({_pairs('w0')})")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pair_counts(bpe.as_words(bpe.pretoken_counts(_documents(spark, sf_dir))))


@QUERIES.add(f"WITH {_WORDS} SELECT l AS \"left\", r AS \"right\", n::BIGINT AS n FROM ({_pairs('w0')}) ORDER BY n DESC, l DESC, r DESC LIMIT 1")
def bpe_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.best_pair(bpe_pair_counts(spark, sf_dir))


def _trained(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    return bpe.train(spread(_documents(spark, sf_dir).select("text")), VOCABULARY, specials=[T.END], min_freq=MIN_FREQ, folder=scratch(spark, "merges"))


@QUERIES.add(f'WITH RECURSIVE {_TRAINED} SELECT rank::INTEGER AS rank, l AS "left", r AS "right", n FROM merges')
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained in rounds over tables; the queries below train on the driver unless the words are too many for it."""
    found = merges.train(spread(_documents(spark, sf_dir).select("text")), VOCABULARY, scratch(spark, "merges"), [T.END], MIN_FREQ)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(found)], "rank int, left int, right int, n long")


@QUERIES.add(f"""WITH RECURSIVE {_TRAINED}, tokens AS (SELECT 0 AS k, list_transform(range(256), lambda i: lower(lpad(printf('%x', i), 2, '0'))) AS t
  UNION ALL SELECT k + 1, list_append(t, t[l + 1] || t[r + 1]) FROM tokens JOIN merges ON rank = k),
whole AS (SELECT list_append(t, '{T.END.encode().hex()}') AS t FROM tokens ORDER BY k DESC LIMIT 1)
SELECT (i - 1)::INTEGER AS token_id, t[i] AS token FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM whole)""")
def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _trained(spark, sf_dir)
    return spark.createDataFrame([(i, t.hex()) for i, t in enumerate(bpe.vocabulary(trained, [T.END]))], "token_id int, token string")


@QUERIES.add(f"""WITH {_COUNTS}, w AS (SELECT pretoken, string_split(rtrim(replace({_TAGGED.format('pretoken')}, '>', '>,'), ','), ',') AS t FROM counts WHERE freq >= {MIN_FREQ})
SELECT DISTINCT replace(replace(t[i], '<', ''), '>', '')::INTEGER AS "left", replace(replace(t[i + 1], '<', ''), '>', '')::INTEGER AS "right", pretoken FROM (SELECT pretoken, t, unnest(range(1, len(t))) AS i FROM w)""")
def pair_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent pre-tokens that hold each pair of bytes."""
    words = bpe.frequent(bpe.pretoken_counts(spread(_documents(spark, sf_dir).select("text"))), MIN_FREQ)
    found = bpe.inverted_index(words.select(F.col("pretoken").alias("word_id"), T.utf8_bytes(F.col("pretoken")).alias("ids")))
    return found.withColumnRenamed("word_id", "pretoken")


def _encoder(spark: SparkSession, sf_dir: str) -> tuple[bpe.Encoder, list[bytes]]:
    trained = _trained(spark, sf_dir)
    tokens = bpe.vocabulary(trained, [T.END])
    return bpe.Encoder(tokens, trained, [T.END]), tokens


#: A text and the end token: merges in the order of their ranks, each over whole pieces, and the end token's own id.
_CODED = f"""{_TRAINED}, listed AS (SELECT list('<' || l || '><' || r || '>' ORDER BY rank) AS m FROM merges),
pieces AS (SELECT doc_id, unnest({_PIECES}) AS p, generate_subscripts({_PIECES}, 1) AS i FROM documents),
coded AS (SELECT p, list_reduce(list_prepend({_TAGGED.format('p')}, m), lambda s, x, k: replace(s, x, '<' || (254 + k) || '>')) AS s FROM (SELECT DISTINCT p FROM pieces), listed),
done AS (SELECT doc_id, coalesce(string_agg(s, '' ORDER BY i), '') || '<{VOCABULARY - 1}>' AS s FROM documents LEFT JOIN pieces USING (doc_id) LEFT JOIN coded USING (p) GROUP BY doc_id)"""


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that end with the end token."""
    return spread(_documents(spark, sf_dir).select("doc_id", "text")).withColumn("text", F.concat("text", F.lit(T.END)))


@QUERIES.add(f"WITH RECURSIVE {_CODED} SELECT doc_id, (length(s) - length(replace(s, '<', '')))::INTEGER AS n_tokens, md5(replace(replace(replace(s, '><', ','), '<', ''), '>', '')) AS ids_md5 FROM done")
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder, _ = _encoder(spark, sf_dir)
    coded = bpe.encode(_ended(spark, sf_dir), encoder)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), _digest("ids").alias("ids_md5"))


@QUERIES.add(f"WITH RECURSIVE {_CODED} SELECT id::INTEGER AS id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, '[0-9]+')) AS id FROM done) GROUP BY id")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id occurs in the encoded corpus, counted by the tasks that encode."""
    encoder, _ = _encoder(spark, sf_dir)
    return bpe.token_counts(_ended(spark, sf_dir), encoder)


@QUERIES.add(f"SELECT doc_id, text || '{T.END}' AS text FROM documents")
def bpe_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder, tokens = _encoder(spark, sf_dir)
    coded = bpe.encode(_ended(spark, sf_dir), encoder).drop("text")
    return bpe.decode(coded, tokens).select("doc_id", "text")


@QUERIES.add("SELECT sum(strlen(text) + 1)::BIGINT AS n_tokens, ceil(sum(strlen(text) + 1) * 2 / (8.0 * 1024))::BIGINT AS steps FROM documents")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens, each text ended by one more, and the steps of 8 x 1024 tokens for two epochs."""
    n = F.sum(F.octet_length("text") + 1)
    return _documents(spark, sf_dir).agg(n.cast("long").alias("n_tokens"), F.ceil(n * 2 / F.lit(8.0 * 1024)).cast("long").alias("steps"))


@QUERIES.add(f"""WITH RECURSIVE sizes AS (SELECT (doc_id // {BATCH})::BIGINT AS batch, sum(strlen(text))::BIGINT AS n_tokens FROM documents GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY batch) AS k FROM sizes),
rolled AS (SELECT k, batch, n_tokens, 0 AS shard, n_tokens AS held FROM numbered WHERE k = 1
  UNION ALL SELECT n.k, n.batch, n.n_tokens, CASE WHEN r.held >= {SHARD} THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.held >= {SHARD} THEN n.n_tokens ELSE r.held + n.n_tokens END
  FROM rolled r JOIN numbered n ON n.k = r.k + 1)
SELECT batch, n_tokens, shard FROM rolled""")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n"))
    return sequence.shard_batches(sized, "n", "doc_id", BATCH, SHARD)


@QUERIES.add(f"""WITH stream AS (SELECT regexp_extract_all(string_agg(hex(encode(text)), '' ORDER BY doc_id), '.{{1,{2 * BLOCK}}}') AS parts FROM documents),
cut AS (SELECT unnest(range(1, len(parts))) AS b, parts[b] AS x, parts[b + 1][1:2] AS after FROM stream)
SELECT b - 1 AS block, md5({_LISTED.format('x')}) AS x_md5, md5({_LISTED.format('(x[3:] || after)')}) AS y_md5 FROM cut""")
def token_blocks_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spread(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.octet_length("text").alias("n"), bpe.byte_ids(F.col("text")).alias("ids"))
    return sequence.blocks(ids, "ids", "doc_id", BLOCK, F.col("n")).select("block", _digest("x").alias("x_md5"), _digest("y").alias("y_md5"))


@QUERIES.add("SELECT doc_id, lang, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 32")
def first_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "source")
    return instruct.first_per_group(docs, "source", 32, "doc_id")


QUOTAS = {"en": 120, "fr": 90, "de": 20}


@QUERIES.add("SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS rank FROM documents) WHERE (lang = 'en' AND rank <= 120) OR (lang = 'fr' AND rank <= 90) OR (lang = 'de' AND rank <= 20)")
def quota_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.quota_mix(_documents(spark, sf_dir).select("doc_id", "lang"), "lang", QUOTAS, "doc_id")


@QUERIES.add("SELECT lang AS task, count(*) AS n FROM documents GROUP BY lang")
def task_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy(F.col("lang").alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task")


@QUERIES.add("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':1337'), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.05)) THEN 'val' ELSE 'train' END AS split FROM documents")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.seeded_split(_documents(spark, sf_dir).select("doc_id"), "doc_id", 1337, 0.05).select("doc_id", "split")


@QUERIES.add("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def keep_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5"))
    return instruct.keep_first(docs, "text_md5", "doc_id")


@QUERIES.add("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each text, read as a file stream and kept in a table."""
    from millrace.streaming.dedup import stored, stream_new_rows

    place = scratch(spark, "stream")
    docs = _documents(spark, sf_dir)
    path = f"{sf_dir}/documents.parquet"
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_dir)
    if not _is_folder(spark, path):
        stream = stream.where(F.col("_metadata.file_name") == "documents.parquet")
    keyed = stream.select("doc_id", F.md5("text").alias("text_md5"))
    stream_new_rows(keyed, f"{place}/table", f"{place}/state", "text_md5", "doc_id").awaitTermination()
    return stored(spark, f"{place}/table", docs.select("doc_id", F.md5("text").alias("text_md5"))).select("doc_id", "text_md5")


def _is_folder(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(found).isDirectory()


@QUERIES.add("""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b, strlen(text) AS n FROM documents WHERE strlen(text) > 3),
f AS (SELECT doc_id, list_filter(range(1, n - 2), lambda i: b[i] = b[n - 2] AND b[i + 1] = b[n - 1] AND b[i + 2] = b[n]) AS spots, b AS h FROM b)
SELECT doc_id, nullif(array_to_string(list_sort(list_distinct(list_transform(spots, lambda i: ('0x' || h[i + 3])::INTEGER))), ','), '') AS banned FROM f""")
def ngram_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that would repeat a 4-gram of the text if they came next."""
    from millrace.functions.numeric import banned_next

    ids = _documents(spark, sf_dir).where(F.octet_length("text") > 3).select("doc_id", T.utf8_bytes(F.col("text")).alias("ids"))
    return ids.select("doc_id", banned_next(F.col("ids"), 4).alias("b")).select("doc_id", F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda i: i.cast("string")), ",")).alias("banned"))


PROMPTS = ("describe it", "what is this about?", "name its parts", "sum it up", "give a title")


@QUERIES.add("SELECT doc_id, ['describe it', 'what is this about?', 'name its parts', 'sum it up', 'give a title'][1 + ('0x' || md5(doc_id || ':5')[1:12])::BIGINT % 5] AS prompt FROM documents")
def prompt_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", sequence.hashed_choice(F.col("doc_id"), 5, PROMPTS).alias("prompt"))


@QUERIES.add("""WITH s AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE strlen(text) > 64),
d AS (SELECT i AS draw, ('0x' || md5(i || ':9')[1:12])::BIGINT % (SELECT count(*) FROM s) AS k FROM range(200) t(i)),
p AS (SELECT draw, doc_id, h, ('0x' || md5(draw || ':10')[1:12])::BIGINT % (n - 64) AS start FROM d JOIN s USING (k))
SELECT draw, doc_id AS shard, start, md5(h[2 * start + 1 : 2 * start + 128]) AS x_md5, md5(h[2 * start + 3 : 2 * start + 130]) AS y_md5 FROM p""")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n"), bpe.byte_ids(F.col("text")).alias("ids"))
    code = lambda c: F.md5(F.array_join(F.transform(c, lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    found = sequence.random_windows(ids, "ids", "doc_id", 200, 64, 9, F.col("n"))
    return found.select("draw", "shard", "start", code("x").alias("x_md5"), code("y").alias("y_md5"))


@QUERIES.add("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS r FROM documents) WHERE r = 1 ORDER BY doc_id LIMIT 32")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each length, 32 at most: the evaluation subset rule."""
    return instruct.distinct_on(_documents(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id", 32)


@QUERIES.add("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, unnest(range(place, ((n + 31) // 32) * 32, n)) AS slot FROM o) SELECT doc_id, slot // 32 AS batch, slot % 32 AS slot FROM s""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.epoch_batches(_documents(spark, sf_dir).select("doc_id"), "doc_id", 7, 32)


def _draws(run: int, seed: int) -> str:
    return f"""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE n_chars <= 400),
d AS (SELECT i AS draw, ('0x' || md5(i || ':{seed}')[1:12])::BIGINT % (SELECT count(*) FROM s) AS start, unnest(range({run})) AS slot FROM range(100) t(i))
SELECT draw, slot, doc_id FROM d JOIN s ON s.place = (d.start + d.slot) % (SELECT count(*) FROM s)"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("n_chars <= 400").select("doc_id")


@QUERIES.add(_draws(1, 11))
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred draws among the documents that are short enough."""
    return sequence.drawn(_short(spark, sf_dir), "doc_id", 100, 11)


@QUERIES.add(_draws(8, 12))
def contiguous_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred batches of eight, each from a random start on."""
    return sequence.drawn(_short(spark, sf_dir), "doc_id", 100, 12, 8)


def _rounds(target: int, least: int, patience: int) -> str:
    return f"""WITH k AS (SELECT doc_id, round FROM (SELECT doc_id, doc_id // 16 AS round, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1),
g AS (SELECT r.round, count(k.doc_id) AS gain FROM (SELECT DISTINCT doc_id // 16 AS round FROM documents) r LEFT JOIN k USING (round) GROUP BY 1),
s AS (SELECT round, sum(gain) OVER (ORDER BY round) AS held, sum((gain < {least})::INTEGER) OVER (ORDER BY round ROWS BETWEEN {patience - 1} PRECEDING AND CURRENT ROW) AS low FROM g)
SELECT doc_id, round FROM k WHERE round <= coalesce((SELECT min(round) FROM s WHERE held >= {target} OR low = {patience}), round) ORDER BY doc_id LIMIT {target}"""


def _until(spark: SparkSession, sf_dir: str, target: int, least: int, patience: int) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("round"), "text")
    return instruct.until_target(docs, "text", "round", "doc_id", target, least, patience).select("doc_id", "round")


@QUERIES.add(_rounds(150, 4, 12))
def rounds_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of sixteen candidates until 150 different ones are there."""
    return _until(spark, sf_dir, 150, 4, 12)


@QUERIES.add(_rounds(1_000_000, 16, 2))
def rounds_until_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of sixteen candidates until two in a row bring repeats."""
    return _until(spark, sf_dir, 1_000_000, 16, 2)


def _delivered(spark: SparkSession, sf_dir: str, target: int, least: int, patience: int) -> DataFrame:
    """The rounds as a stream that comes in four deliveries; the loop goes on from its state after each."""
    from millrace.streaming.rounds import run_rounds

    place = scratch(spark, "rounds")
    docs = _documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("round"), "text")
    n = docs.agg(F.max("round")).first()[0] + 1
    for quarter in range(4):
        docs.where(F.floor(F.col("round") * 4 / n) == quarter).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{place}/in")
        found = run_rounds(stream, f"{place}/state", "text", "round", "doc_id", target, least, patience)
    return found.select("doc_id", "round")


@QUERIES.add(_rounds(150, 4, 12))
def stream_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a stream until 150 different texts are there."""
    return _delivered(spark, sf_dir, 150, 4, 12)


@QUERIES.add(_rounds(1_000_000, 16, 2))
def stream_until_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a stream until two in a row bring repeats."""
    return _delivered(spark, sf_dir, 1_000_000, 16, 2)
