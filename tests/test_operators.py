"""Golden values and invariants of sequence, instruction, evaluation and numeric operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import labels, numeric, rules
from millrace.operators import evaluation, instruct, sequence
from millrace.plans import registry


def test_rolling_shards():
    assert sequence.roll([9, 9, 9, 9, 2], 10) == [0, 0, 1, 1, 2]
    assert sequence.roll([9, 9, 9, 9, 2], 10, first=5) == [5, 5, 6, 6, 7]
    assert sequence.roll([], 10) == []


@pytest.mark.parametrize(("width", "least"), [(1, 10), (3, 10), (4, 25), (7, 1), (1000, 40), (5, 10_000)])
def test_shards_of_ranges_are_the_fold(spark, width, least):
    rng = random.Random(width)
    sizes = [rng.choice([0, 1, 5, 9, 30]) for _ in range(60)]
    df = spark.createDataFrame([(i * 2 + j, n) for i, n in enumerate(sizes) for j in range(2)], "at long, n long")
    got = {r.batch: (r.n_tokens, r.shard) for r in sequence.shard_batches(df, "n", "at", 2, least, 3, width).collect()}
    assert [got[i] for i in range(60)] == list(zip([2 * n for n in sizes], sequence.roll([2 * n for n in sizes], least, 3), strict=True))


def test_first_rows_of_hot_groups(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'few', 'hot') AS g")
    got = instruct.first_per_group(df, "g", 1500, "id").groupBy("g").agg(F.count(F.lit(1)), F.max("id"), F.max("rank")).collect()
    assert sorted(map(tuple, got)) == [("few", 500, 4990, 500), ("hot", 1500, 1666, 1500)]


def test_yes_or_no_is_right_by_form(spark):
    rows = spark.createDataFrame([("yesno", "yes", " No "), ("yesno", "yes", "maybe"), ("copy", "a", "a"), ("copy", "a", "b"), ("yesno", "yes", None)], "task string, gold string, pred string")
    columns = F.col("task"), F.col("gold"), F.col("pred")
    assert [tuple(r) for r in rows.select(evaluation.is_mode_right(*columns), evaluation.is_right(*columns)).collect()] == [(True, False), (False, False), (True, True), (False, False), (False, False)]


def test_running_sum_in_ranges(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, n int").repartition(7)
    got = {r.at: r.before for r in sequence.running_sum(df, "n", "at", width=50).collect()}
    total = 0
    for at, n in rows:
        assert got[at] == total
        total += n


@pytest.mark.parametrize("length", [1, 3, 5, 64])
def test_blocks_are_the_stream(spark, length):
    rng = random.Random(length)
    texts = [[rng.randint(0, 255) for _ in range(rng.choice([0, 1, 2, 7, 20]))] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "at long, ids array<int>")
    stream = [i for t in texts for i in t]
    got = {r.block: (r.x, r.y) for r in sequence.blocks(df, "ids", "at", length).collect()}
    want = {b: (stream[b * length : (b + 1) * length], stream[b * length + 1 : (b + 1) * length + 1]) for b in range((len(stream) - 1) // length)}
    assert got == want


def test_label_mask(spark):
    row = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 7, 8, 0])], "p array<int>, f array<int>")
    assert row.select(sequence.label_mask(F.col("p"), F.col("f"))).first()[0] == [-666, -666, -666, 7, 8, 0]
    assert row.select(sequence.label_mask(F.col("p"), F.col("f"), 1)).first()[0] == [-666] * 4 + [7, 8, 0]
    assert row.select(sequence.next_tokens(F.col("p"))).first()[0] == [2, 3]
    assert row.select(sequence.last_tokens(F.col("f"), 2)).first()[0] == [8, 0]


def passes(spark, rule, instruction, output):
    return spark.createDataFrame([(instruction, output)], "i string, o string").select(rule(F.col("i"), F.col("o"))).first()[0]


def test_rules(spark):
    assert not passes(spark, rules.factoid, "Where is it?", "North America.")
    assert passes(spark, rules.factoid, "Where is it?", "In Asia.")
    assert passes(spark, rules.factoid, "What is rain?", "Water falling from clouds.")


@pytest.mark.parametrize(("text", "repeats"), [("a b a d", True), ("a a b d", True), ("a b c c", False), ("", False), ("a a", False)])
def test_near_repeat(spark, text, repeats):
    assert spark.createDataFrame([(text,)], "s string").select(rules.near_repeat(F.col("s"))).first()[0] is repeats


def test_near_repeat_finds_the_words_once(spark, sf):
    """Not at each place, which took time with the square of a text's length."""
    for name in ("near_repeat", "sft_rules_how_why_short"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == plan.count("exists(") > 0
    df = spark.createDataFrame([(None,), ("a b a",), ("a b",)], "s string").coalesce(1)
    assert [r[0] for r in df.select(rules.near_repeat(F.col("s"))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(rules.near_repeat(F.col("s"), 4)).collect()] == [False, False, False]


@pytest.mark.parametrize(
    ("text", "objects"),
    [
        ("Green ellipse on the left, yellow rectangle on the right", [("left", "green", "ellipse"), ("right", "yellow", "rectangle")]),
        ("one blue rectangle on the left while some white triangle floats about on the right", [("left", "blue", "rectangle"), ("right", "white", "triangle")]),
        ("on the left: nothing. A BLACK-ELLIPSE, on\tthe\nright!", [("right", "black", "ellipse")]),
        ("purple circle on the left and a white thing on the right", []),
        ("", []),
    ],
)
def test_side_objects(spark, text, objects):
    got = spark.createDataFrame([(text,)], "s string").select(labels.side_objects(F.col("s"))).first()[0]
    assert [tuple(o) for o in got] == objects


def test_scores_of_scenes(spark):
    gold = "Red ellipse on the left; some WHITE-triangle floats about in the air on the right"
    preds = {gold.lower(): (1, 1, 1), "red ellipse on the left": (0, 1, 0), "white triangle on the right": (0, 0, 1), "nothing": (0, 0, 0), None: (0, 0, 0)}
    df = spark.createDataFrame([(gold, p) for p in preds] + [("nothing", "nothing"), ("red ellipse on the left.", "a red ellipse on  the left")], "g string, p string")
    want = [*preds.values(), (0, 0, 0), (1, 1, 0)]
    names = ("scene", "left_object", "right_object")
    each = [labels.score(F.lit(n), F.col("g"), F.col("p")) for n in names]
    found = df.select(labels.scores(F.col("g"), F.col("p")).alias("all"), *[c.alias(n) for c, n in zip(each, names, strict=True)]).coalesce(1).collect()
    assert [tuple(r[n] for n in names) for r in found] == want
    assert [[(s.task, s.score) for s in r["all"]] for r in found] == [list(zip(names, w, strict=True)) for w in want]


def test_scene_score_reads_a_text_once(spark, sf):
    """Its letters are cleaned once for each of the two texts and each side is looked for once; it was 69 and 60 times a row and task."""
    plan = registry.QUERIES["scene_score"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z]+") == 2 and plan.count(r"\bon\s+the\s+left\b") == 2


def test_keep_first_and_quota(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "x"), (4, "b", "z")], "at long, k string, g string")
    assert sorted((r.at, r.k) for r in instruct.keep_first(df, "k", "at").collect()) == [(1, "a"), (2, "b")]
    assert sorted(r.at for r in instruct.quota_mix(df, "k", {"a": 1, "b": 2, "c": 5}, "at").collect()) == [1, 2, 4]
    assert [r.source_order for r in instruct.ordered_union(df, df).orderBy("source_order").collect()] == [0] * 4 + [1] * 4


def test_merge_topics_is_stagewise(spark):
    row = lambda at, key, out="It is so every day of the year": (at, "why x y", out, key)
    schema = "ordinal long, instruction string, output string, split_key string"
    one = spark.createDataFrame([row(0, "k1"), row(1, "k1"), row(2, "k2")], schema)
    two = spark.createDataFrame([row(0, "k2"), row(1, "k3", "Use it well"), row(2, "k4"), row(3, "k5")], schema)
    got = instruct.merge_topics({"factoid_short": one, "how_why_short": two}, limit=2).collect()
    assert sorted((r.topic_order, r.split_key) for r in got) == [(0, "k1"), (0, "k2"), (1, "k4"), (1, "k5")]


def test_seeded_split_counts(spark):
    ids = spark.range(101).withColumnRenamed("id", "k")
    got = instruct.seeded_split(ids, "k", 7, 0.05).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 5, "train": 96}


def test_answers(spark):
    texts = ["Fine.", "Yes, it is", "yesterday", "", "I am not sure", "no", "w " * 81, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(rules.answers(F.col("s"))).collect()]
    assert got == [True, False, True, False, False, False, False, False]


def test_latest_checkpoint_of_nothing(spark):
    assert evaluation.latest_checkpoint(spark.createDataFrame([], "path string")).collect() == []


def on(spark, values, column):
    return spark.createDataFrame([(values,)], "x array<double>").select(column(F.col("x"))).first()[0]


def test_numeric_goldens(spark):
    assert on(spark, [1.0, 3.0, 3.0, 2.0], lambda x: numeric.target_rank(x, F.lit(3))) == 3
    assert np.allclose(on(spark, [0.5, 0.3, 0.15, 0.05], lambda x: numeric.top_p(x, 0.9)), [0.5 / 0.95, 0.3 / 0.95, 0.15 / 0.95, 0])
    assert on(spark, [1.0, 5.0, 5.0, 2.0], lambda x: numeric.top_k(x, 1)) == [-math.inf, 5.0, 5.0, -math.inf]
    assert np.allclose(on(spark, [2.0, -2.0, 1.0], lambda x: numeric.repetition_penalty(x, F.array(F.lit(0), F.lit(1), F.lit(0)), 2.0)), [1.0, -4.0, 1.0])
    rate = lambda s: spark.range(1).select(numeric.cosine_rate(F.lit(s), 2e-4, 2e-5, 2000, 10000)).first()[0]
    assert np.allclose([rate(s) for s in (0, 1000, 2000, 6000, 10000, 20000)], [0, 1e-4, 2e-4, 1.1e-4, 2e-5, 2e-5])


def test_numeric_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=8)
    assert np.allclose(on(spark, x.tolist(), numeric.softmax), np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    assert np.allclose(on(spark, x.tolist(), lambda v: numeric.rms_norm(v, 2.0)), x * 2 / np.sqrt((x * x).mean() + 1e-5))
    angle = 3 / 10000.0 ** (np.arange(0, 8, 2) / 8)
    even, odd = x[::2] * np.cos(angle) - x[1::2] * np.sin(angle), x[1::2] * np.cos(angle) + x[::2] * np.sin(angle)
    assert np.allclose(on(spark, x.tolist(), lambda v: numeric.rope(v, F.lit(3))), np.stack([even, odd], axis=1).ravel())


def test_far_ordinals_leave_ranges_even(spark):
    df = spark.range(40_000).select(F.when(F.col("id") == 7, F.lit(1 << 60)).when(F.col("id") == 8, F.lit(-(1 << 61))).otherwise(F.col("id") * F.col("id")).alias("at"), F.lit(1).alias("one"))
    sizes = [r["count"] for r in df.groupBy(sequence.ranges_of(df, "at", 1000).alias("r")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1300
    placed = sequence.running_sum(df, "one", "at", "place", 1000)
    assert placed.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[0:3] == (0, 39_999, 40_000)
    order = [r.at for r in placed.orderBy("place").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_running_sum_in_ranges_of_any_width(spark, width):
    rng = random.Random(width)
    rows = sorted((rng.randrange(-(1 << 40), 1 << 40), rng.randrange(5)) for _ in range(60))
    got = {r.at: r.before for r in sequence.running_sum(spark.createDataFrame(rows, "at long, n int"), "n", "at", width=width).collect()}
    assert got == {at: sum(n for a, n in rows if a < at) for at, _ in rows}
    assert sequence.running_sum(spark.createDataFrame([], "at long, n int"), "n", "at").count() == 0


def test_large_quotas_limit_rows_before_the_shuffle(spark):
    df = spark.range(0, 9000, numPartitions=3).select((F.col("id") % 2).alias("g"), F.col("id").alias("at"))
    found = instruct.first_per_group(df, "g", 1200, "at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "WindowGroupLimit" in below and "1200" in below
    assert sorted(r.at for r in found.collect()) == list(range(2400))
