"""Golden values of the text functions."""

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("I don't  know 42!\n", ["I", " don", "'t", " ", " know", " 42", "!", "\n"]),
        ("a   b\n\nc", ["a", "  ", " b", "\n", "\n", "c"]),
        ("DON'T", ["DON", "'", "T"]),
        ("a　　　b", ["a", "　　", "　", "b"]),
        ("", []),
    ],
)
def test_pretokens(spark, text, pieces):
    assert one(spark, text, T.pretokens) == pieces


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aé7 '!\n\t　ts", max_size=30))
def test_pretokens_like_python(spark, text):
    assert one(spark, text, T.pretokens) == regex.findall(T.PRETOKEN, text)


@pytest.mark.parametrize("text", ["", " ", " a  b c\x1cd\x85 ", " x"])
def test_white_space_like_python(spark, text):
    assert one(spark, text, T.one_line) == " ".join(text.split())
    assert one(spark, text, T.word_count) == len(text.split())
    assert one(spark, text, T.strip) == text.strip()


def test_specials_win_over_the_pattern(spark):
    assert one(spark, "hi!! <|b|>x<|a|><|ab|>", lambda s: T.pretokens_keeping(s, ["<|a|>", "<|b|>", "<|ab|>"])) == ["hi", "!!", " ", "<|b|>", "x", "<|a|>", "<|ab|>"]
    assert one(spark, "a<|x|>b", lambda s: T.without_specials(s, ["<|x|>"])) == ["a", "b"]


def test_chat(spark):
    assert one(spark, " Hi ", T.chat_prompt) == "<|user|>\nHi\n<|assistant|>\n"
    assert one(spark, " Hi ", lambda s: T.chat_example(s, F.lit(" Yes. "))) == "<|user|>\nHi\n<|assistant|>\nYes.<|endoftext|>"
    assert one(spark, " a <|endoftext|> b", T.until_end) == "a"


def test_key(spark):
    assert one(spark, "What is rain?", lambda s: T.split_key(F.lit("factoid_short"), s)) == "6954a2b9fe65dfa2d3e144f4cfb4e50cd835bd94"


def test_bytes(spark):
    assert one(spark, "aé", T.utf8_bytes) == list("aé".encode())


def test_answers(spark):
    items = one(spark, '```json\n{"items": [{"instruction": "a", "output": "b"}]}\n```', T.answer_items)
    assert [tuple(i) for i in items] == [("a", "b")]
    assert [tuple(i) for i in one(spark, '{"items": {"instruction": "a", "output": "b"}}', T.answer_items)] == [("a", "b")]
    for bad in ("", "no", '{"items": 3}', None):
        assert one(spark, bad, T.answer_items) == []
