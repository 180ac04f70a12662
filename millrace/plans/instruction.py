"""Queries over instruction/answer pairs: templates, keys, rules, merging, masks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as T
from millrace.operators import instruct, sequence
from millrace.plans.book import Book, scratch, table
from millrace.sources.store import stored

QUERIES = Book()
BRANDS = ("acmebot",)

#: Pairs that pass and fail each rule, beside those of the conversations.
EXAMPLES = [
    ("What is  rain?", "Water falling from clouds."),
    ("Where is Canada located?", "North America."),
    ("Where is Japan located?", "In Asia."),
    ("What do cats eat?", "Is it fish?"),
    ("Who made acmebot for us?", "A small team of people."),
    ("When did the war end?", "I don't know the answer."),
    ("What is rain?", "Drops of water."),
    ("How do plants grow well?", "They need water, light and good soil every day."),
    ("How to grow plants indoors?", "They need water, light and good soil every day."),
    ("Why do people feel stress?", "They have too much work and too little time."),
    ("Why is the sky blue?", "Light of short waves scatters more than that of long waves."),
    ("How do birds fly so far?", "They rest and rest again on long trips over sea."),
    ("How can I clean a pan?", "Use warm water, salt and a soft brush today."),
    ("Why do leaves fall down?", "Trees save water in winter and drop what costs too much."),
    ("My name is Ann. What is my name?", "Ann"),
    ("I live in Rome. Where do I live?", "Rome, Italy"),
    ("Hello, my car is red. What is my car?", "a red car"),
    ("My job is baking. What is my job?", "it is baking"),
    ("Name a fruit, one word only", "apple"),
    ("Name a fruit, one word only", "an apple"),
    ("Describe snow, short phrase only", "cold white rain"),
    ("Describe snow, short phrase only", "snow is cold"),
    ("Describe fire, one short sentence only", "Fire is hot and bright."),
    ("Describe fire, one short sentence only", "Fire!"),
    ("Name a tool, one word only and short phrase only", "hammer"),
    ("  Which\tcolor is the sea? ", "Blue or\ngreen at times."),
    ("", "nothing asked"),
    ("a b", "c"),
]


class _Listed:
    """The fixed word lists once more, so that the SQL does not share them with the rules."""

    REFUSALS = ("i don't know", "i cant", "i can't")
    FACTOID_STARTS = ("what ", "which ", "who ", "where ", "when ")
    REASON_STARTS = ("how ", "why ")
    REASON_TOPICS = ("stress", "anxiety", "depression", "dry skin", "face mask", "diet", "weight loss", "therapy", "doctor", "medical", "mental health", "sunburn", "sunscreen")
    REASON_PHRASES = ("a good example", "the best way", "use a small amount", "small book", "strong, strong", "for a small", "a bread-like", "like a bread", "use a bread-like")
    REASON_FALLBACK_STARTS = ("use ", "place ", "keep ")
    FACT_PHRASES = ("my name is ", "her name is ", "his name is ", "i live in ", "i am from ", "my favorite ", "i work at ", "my dog is named ", "my cat is named ", "my hometown is ", "my school is ", "my job is ", "my car is ", "my city is ")
    SLOT_VERBS = ("is", "are", "was", "were", "means", "called", "named", "lives", "works", "stands")
    FORM_TAGS = ("one word only", "short phrase only", "one short sentence only")
    FORM_PHRASES = ("the word", "the phrase", "a good example", "an example", "the answer is", "this means", "refers to", "is a word", "is a phrase", "for example")
    PHRASE_VERBS = ("is", "are", "was", "were", "means", "called", "named", "lives", "works", "stands", "can", "will", "should")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"


_EXAMPLES = "examples AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_quoted(i)}, {_quoted(o)})" for k, (i, o) in enumerate(EXAMPLES)) + ") t(ordinal, instruction, output))"
_PAIRS = "pairs AS (SELECT conv_id, turn, text AS instruction, nt AS output FROM (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
_ALL = f"{_PAIRS}, {_EXAMPLES}, every AS (SELECT ordinal::BIGINT AS ordinal, instruction, output FROM examples UNION ALL SELECT 1000 + conv_id * 1000 + turn, instruction, output FROM pairs)"
_LINE = r"trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"
_CLEAN = f"{_ALL}, clean AS (SELECT ordinal, i AS instruction, o AS output, lower(i) AS li, lower(o) AS lo, len(list_filter(string_split(i, ' '), lambda x: x <> '')) AS ni, len(list_filter(string_split(o, ' '), lambda x: x <> '')) AS no FROM (SELECT ordinal, {_LINE.format('instruction')} AS i, {_LINE.format('output')} AS o FROM every))"
_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


def _any(column: str, parts: tuple[str, ...], how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, {_quoted(p)})" for p in parts) + ")"


_NEAR = "(len(w) >= {least} AND len(list_filter(range(1, len(w) - 1), lambda k: w[k] = w[k + 1] OR w[k] = w[k + 2])) > 0)"
_COMMON = f"(instruction <> '' AND output <> '' AND ni BETWEEN 3 AND 40 AND NOT ends_with(output, '?') AND NOT {_any('li', BRANDS)} AND NOT {_any('lo', BRANDS)} AND NOT {_any('lo', _Listed.REFUSALS)})"
_NO_YES = "NOT (starts_with(lo, 'yes') OR starts_with(lo, 'no'))"
_TOPICS = f"NOT starts_with(li, 'how to ') AND NOT {_any('li', _Listed.REASON_TOPICS)} AND NOT {{phrases}}"
_PUNCT = """regexp_matches(output, '[.!?,:;"()]')"""


def _verbs(words: tuple[str, ...]) -> str:
    return f"regexp_matches(lo, '\\b({'|'.join(words)})\\b')"


_WORDS = "regexp_extract_all(lo, '[a-z]+')"
_RULES = {
    "factoid_short": f"({_any('li', _Listed.FACTOID_STARTS, 'starts_with')} AND no BETWEEN 2 AND 18 AND {_NO_YES})",
    "how_why_short": f"({_any('li', _Listed.REASON_STARTS, 'starts_with')} AND no BETWEEN 6 AND 28 AND {_NO_YES} AND {_TOPICS.format(phrases=_any('lo', _Listed.REASON_PHRASES))} AND NOT {_NEAR.format(least=6)})",
    "slot_following": f"(({_any('li', tuple(' ' + p for p in _Listed.FACT_PHRASES))} OR {_any('li', _Listed.FACT_PHRASES, 'starts_with')}) AND no BETWEEN 1 AND 4 AND {_NO_YES} AND NOT {_PUNCT} AND NOT {_verbs(_Listed.SLOT_VERBS)})",
    "short_form_answer": f"({_any('li', _Listed.FORM_TAGS)} AND NOT {_any('lo', _Listed.FORM_PHRASES)} AND (NOT contains(li, 'one word only') OR (no = 1 AND NOT {_PUNCT})) AND (NOT contains(li, 'short phrase only') OR (no BETWEEN 1 AND 4 AND NOT {_PUNCT} AND NOT {_verbs(_Listed.PHRASE_VERBS)})) AND (NOT contains(li, 'one short sentence only') OR (no BETWEEN 4 AND 10 AND NOT regexp_matches(output, '[?!]'))))",
}
_SPLIT = f", ruled AS (SELECT *, {_WORDS} AS w FROM clean)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.turn_pairs(table(spark, sf_dir, "conversations"))


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples, then the conversations' pairs, with an ordinal."""
    some = spark.createDataFrame([(k, i, o) for k, (i, o) in enumerate(EXAMPLES)], "ordinal long, instruction string, output string")
    return some.union(_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("ordinal"), "instruction", "output"))


@QUERIES.add(f"WITH {_PAIRS} SELECT conv_id, turn, instruction, output, 'assistant_qa' AS task FROM pairs")
def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("task", F.lit("assistant_qa"))


@QUERIES.add(f"WITH {_PAIRS}, s AS (SELECT conv_id, turn, {_STRIP.format('instruction')} AS i, {_STRIP.format('output')} AS o FROM pairs) SELECT conv_id, turn, '<|user|>' || chr(10) || i || chr(10) || '<|assistant|>' || chr(10) AS prompt, '<|user|>' || chr(10) || i || chr(10) || '<|assistant|>' || chr(10) || o || '<|endoftext|>' AS example FROM s")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = F.col("instruction"), F.col("output")
    return _pairs(spark, sf_dir).select("conv_id", "turn", T.chat_prompt(i).alias("prompt"), T.chat_example(i, o).alias("example"))


@QUERIES.add(f"WITH {_CLEAN} SELECT ordinal, sha1('assistant_qa:factoid_short:' || li) AS split_key FROM clean")
def sft_split_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.one_line(F.col("instruction"))
    return _every(spark, sf_dir).select("ordinal", T.split_key(F.lit("factoid_short"), clean).alias("split_key"))


@QUERIES.add(f"WITH {_CLEAN} SELECT split_key, min(ordinal) AS ordinal FROM (SELECT ordinal, sha1('assistant_qa:factoid_short:' || li) AS split_key FROM clean) GROUP BY split_key")
def sft_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct.keep_first(sft_split_key(spark, sf_dir), "split_key", "ordinal")


@QUERIES.add(f"WITH {_CLEAN} SELECT ordinal, {_COMMON} AS passes FROM clean")
def sft_rules_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = T.one_line(F.col("instruction")), T.one_line(F.col("output"))
    return _every(spark, sf_dir).select("ordinal", rules.common(i, o, BRANDS).alias("passes"))


#: Questions of every topic around the first words of each conversation's turns, answered with the first words of the reply.
FRAMES = [
    ("What of ", ""), ("Who told you: ", ""), ("How come ", ""), ("Why did ", ""), ("Well, my job is odd. ", ""), ("I live in Rome near ", ""), ("You see, my city is far. ", ""), ("I work at ", ""), ("Complete ", " (one word only)"), ("Complete ", " (short phrase only)"),
    ("Complete ", " (one short sentence only)"),
]
_FRAMED = f"""base AS (SELECT conv_id, turn, string_split({_LINE.format('instruction')}, ' ') AS i, string_split({_LINE.format('output')}, ' ') AS o FROM pairs),
framed AS (SELECT 1000000000 + (conv_id * 1000 + turn) * 16 + k AS ordinal, [{', '.join(_quoted(a) for a, _ in FRAMES)}][k + 1] || array_to_string(i[1 : 1 + (conv_id + turn + k) % 5], ' ') || [{', '.join(_quoted(b) for _, b in FRAMES)}][k + 1] AS instruction,
  CASE WHEN (conv_id + k) % 11 = 0 THEN 'No, ' ELSE '' END || array_to_string(o[1 : 1 + (conv_id * 3 + turn * 7 + k * 5) % CASE WHEN k < 4 THEN 24 ELSE 6 END], ' ') || ['.', '?', '', ''][1 + (conv_id + turn) % 4] AS output FROM base, range({len(FRAMES)}) t(k))"""
_CLEAN_FRAMED = _CLEAN.replace(", clean AS (", f", {_FRAMED}, clean AS (").replace("FROM every)", "FROM (SELECT * FROM every UNION ALL SELECT ordinal, instruction, output FROM framed))")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.split(T.one_line(F.col(c)), " ", -1)
    pairs = _pairs(spark, sf_dir).select("conv_id", "turn", words("instruction").alias("i"), words("output").alias("o"), F.explode(F.array(*map(F.lit, range(len(FRAMES))))).alias("k"))
    pick = lambda options, n: F.get(F.array(*map(F.lit, options)), n.cast("int"))
    first = lambda c, n: F.array_join(F.slice(c, F.lit(1), (n + 1).cast("int")), " ")
    c, t, k = F.col("conv_id"), F.col("turn"), F.col("k")
    asked = F.concat(pick([a for a, _ in FRAMES], k), first("i", (c + t + k) % 5), pick([b for _, b in FRAMES], k))
    told = F.concat(F.when((c + k) % 11 == 0, "No, ").otherwise(""), first("o", (c * 3 + t * 7 + k * 5) % F.when(k < 4, 24).otherwise(6)), pick([".", "?", "", ""], (c + t) % 4))
    return pairs.select((F.lit(1_000_000_000) + (c * 1000 + t) * 16 + k).alias("ordinal"), asked.alias("instruction"), told.alias("output"))


def _kind(topic: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return instruct.generated(_every(spark, sf_dir).union(_framed(spark, sf_dir)), topic, BRANDS).select("ordinal", "instruction", "output", "task", "topic", "split_key")

    query.__name__ = f"sft_rules_{topic}"
    return query


_GENERATED = "SELECT ordinal, instruction, output, 'assistant_qa' AS task, '{0}' AS topic, sha1('assistant_qa:{0}:' || li) AS split_key FROM ruled WHERE {1} AND {2}"
for _topic, _rule in _RULES.items():
    QUERIES.add(f"WITH {_CLEAN_FRAMED}{_SPLIT} {_GENERATED.format(_topic, _COMMON, _rule)}")(_kind(_topic))


@QUERIES.add(f"WITH {_CLEAN}{_SPLIT} SELECT ordinal, {_NEAR.format(least=3)} AS repeats FROM ruled")
def near_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir).select("ordinal", rules.near_repeat(T.one_line(F.col("output"))).alias("repeats"))


_AGAIN = f"({_TOPICS.format(phrases=_any('lower(output)', _Listed.REASON_PHRASES[:-1])).replace('li', 'lower(instruction)')} AND NOT {_NEAR.format(least=3)})"
_TIER = f"{_any('lower(output)', _Listed.REASON_FALLBACK_STARTS, 'starts_with')}::INTEGER"


@QUERIES.add(f"WITH {_CLEAN_FRAMED}{_SPLIT}, made AS ({_GENERATED.replace('SELECT ', 'SELECT w, ', 1).format('how_why_short', _COMMON, _RULES['how_why_short'])}) SELECT ordinal, {_TIER} AS tier, split_key FROM made WHERE {_AGAIN} ORDER BY tier, split_key, ordinal LIMIT 150")
def how_why_tier_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = instruct.generated(_every(spark, sf_dir).union(_framed(spark, sf_dir)), "how_why_short", BRANDS)
    return instruct.reason_order(made, 150).select("ordinal", "tier", "split_key")


def _merged() -> str:
    made = {t: f"m_{t} AS ({_GENERATED.replace('SELECT ', 'SELECT w, ', 1).format(t, _COMMON, r)})" for t, r in _RULES.items()}
    parts, steps = [], []
    for k, topic in enumerate(_RULES):
        rows = f"SELECT ordinal, split_key, topic, 0 AS tier FROM m_{topic}"
        if topic == "how_why_short":
            rows = f"SELECT ordinal, split_key, topic, {_TIER} AS tier FROM m_{topic} WHERE {_AGAIN} ORDER BY tier, split_key, ordinal LIMIT 2500"
        steps.append(f"f_{topic} AS (SELECT arg_min(ordinal, (tier, ordinal)) AS ordinal, split_key, '{topic}' AS topic, {k} AS topic_order FROM ({rows}) GROUP BY split_key)")
        parts.append(f"SELECT * FROM f_{topic}")
    return f"WITH {_CLEAN_FRAMED}{_SPLIT}, {', '.join(made.values())}, {', '.join(steps)} {' UNION ALL '.join(parts)}"


@QUERIES.add(_merged())  # keys hold the topic, so no key occurs under two topics
def merge_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(instruct.generated_all(_every(spark, sf_dir).union(_framed(spark, sf_dir)), BRANDS), scratch(spark, "made"))  # the merge reads it three times
    return instruct.merge_tagged(made, list(rules.KINDS).index("how_why_short")).select("ordinal", "split_key", "topic", "topic_order")


_SIZED = f"{_PAIRS}, sized AS (SELECT conv_id, turn, conv_id * 100000 + turn AS place, strlen({_STRIP.format('instruction')}) + 24 AS n_prompt, strlen({_STRIP.format('output')}) AS n_out, {_STRIP.format('output')} AS o FROM pairs)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens of prompts and examples, id 256 at the end."""
    prompt = T.utf8_bytes(T.chat_prompt(F.col("instruction")))
    whole = F.concat(prompt, T.utf8_bytes(T.strip(F.col("output"))), F.array(F.lit(256)))
    return _pairs(spark, sf_dir).select("conv_id", "turn", (F.col("conv_id") * 100000 + F.col("turn")).alias("place"), prompt.alias("prompt"), whole.alias("full"))


@QUERIES.add(f"WITH {_SIZED} SELECT conv_id, turn, (n_prompt + n_out + 1)::INTEGER AS n_full FROM sized WHERE n_prompt + n_out + 1 <= 1024")
def length_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("conv_id", "turn", F.size("full").alias("n_full")).where(F.col("n_full") <= 1024)


@QUERIES.add(f"WITH {_SIZED} SELECT conv_id, turn, n_prompt::INTEGER AS n_ignored, md5(repeat('-666 ', n_prompt) || array_to_string(list_transform(range(1, n_out + 1), lambda i: ('0x' || hex(encode(o))[2 * i - 1 : 2 * i])::INTEGER || ' '), '') || '256 ') AS labels_md5 FROM sized")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = sequence.label_mask(F.col("prompt"), F.col("full"))
    text = F.concat(F.array_join(F.transform(labels, lambda i: i.cast("string")), " "), F.lit(" "))
    return _tokens(spark, sf_dir).select("conv_id", "turn", F.size("prompt").alias("n_ignored"), F.md5(text).alias("labels_md5"))


@QUERIES.add(f"WITH {_SIZED} SELECT conv_id, turn, 8 + n_prompt::INTEGER AS n_ignored, (8 + n_prompt + n_out + 1)::INTEGER AS n_labels FROM sized")
def prefix_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of examples behind eight places that stand for an image."""
    labels = sequence.label_mask(F.col("prompt"), F.col("full"), 8)
    return _tokens(spark, sf_dir).select("conv_id", "turn", labels.alias("l")).select("conv_id", "turn", F.size(F.filter("l", lambda x: x == sequence.IGNORED)).alias("n_ignored"), F.size("l").alias("n_labels"))


@QUERIES.add(f"WITH {_SIZED}, b AS (SELECT *, (row_number() OVER (ORDER BY place) - 1) // 8 AS batch FROM sized) SELECT batch::BIGINT AS batch, count(*) AS n_rows, max(n_prompt + n_out + 1)::INTEGER AS width, (count(*) * max(n_prompt + n_out + 1) - sum(n_prompt + n_out + 1))::BIGINT AS n_padding FROM b GROUP BY batch")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.running_sum(_tokens(spark, sf_dir).withColumn("one", F.lit(1)), "one", "place", "row").withColumn("batch", sequence.batch_of(F.col("row"), 8))
    widths = rows.groupBy("batch").agg(F.max(F.size("full")).alias("width"))
    padded = rows.join(widths, "batch").select("batch", sequence.pad(F.col("full"), F.col("width"), 257).alias("input_ids"))
    return padded.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("input_ids")).alias("width"), F.sum(F.size(F.filter("input_ids", lambda i: i == 257))).cast("long").alias("n_padding"))


@QUERIES.add(f"WITH {_SIZED} SELECT sum(n_out + 1)::BIGINT AS n_supervised, sum(n_prompt + n_out + 1)::BIGINT AS n_tokens FROM sized")
def supervised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).agg(F.sum(F.size("full") - F.size("prompt")).cast("long").alias("n_supervised"), F.sum(F.size("full")).cast("long").alias("n_tokens"))
