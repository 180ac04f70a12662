"""Text functions: pre-tokens, white space, bytes, chat templates, keys and tolerant JSON. All are JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pre-token pattern and the chat template.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
USER, ASSISTANT, PAD, END = "<|user|>", "<|assistant|>", "<|pad|>", "<|endoftext|>"

#: White space as Python's str.split sees it, in a Java pattern.
SPACE = r"[\s\x1c-\x1f]"
#: Marks special tokens while a text is split; private use, not in any of them.
MARK = ""


def pretokens(text: Column) -> Column:
    """array<string> of the pieces of ``text``; together they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def special_pattern(specials: Sequence[str]) -> str:
    """Longest first, so that a special token inside another does not win."""
    return "|".join(re.escape(s) for s in sorted(specials, key=lambda s: (-len(s), s)))


def pretokens_keeping(text: Column, specials: Sequence[str]) -> Column:
    """Pieces of ``text`` in which every special token is a piece of its own."""
    if not specials:
        return pretokens(text)
    marked = F.regexp_replace(text, "(" + special_pattern(specials) + ")", MARK + "$1" + MARK)
    parts = F.filter(F.split(marked, MARK), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(pretokens(p))))


def without_specials(text: Column, specials: Sequence[str]) -> Column:
    """array<string> of the texts between special tokens, which are dropped."""
    return F.split(text, special_pattern(specials)) if specials else F.array(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def one_line(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(one_line(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def letters_only(text: Column) -> Column:
    """Lower-case a-z words with single spaces between and around them."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z]+", " "), F.lit(" "))


def utf8_bytes(text: Column) -> Column:
    """array<int> of the bytes of ``text``."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def chat_prompt(instruction: Column) -> Column:
    return F.concat(F.lit(USER + "\n"), strip(instruction), F.lit("\n" + ASSISTANT + "\n"))


def chat_example(instruction: Column, output: Column) -> Column:
    return F.concat(chat_prompt(instruction), strip(output), F.lit(END))


def until_end(text: Column, end: str = END) -> Column:
    """The text before the first end token, stripped."""
    return strip(F.substring_index(text, end, 1))


def without_fence(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"(?m)^```json\s*|^```\s*|```$", ""))


def answer_items(text: Column) -> Column:
    """array<struct<instruction, output>> under "items" of a JSON answer, a single object wrapped, anything else empty."""
    clean = without_fence(text)
    many = F.from_json(clean, "items array<struct<instruction:string,output:string>>", {"mode": "PERMISSIVE"})["items"]
    one = F.from_json(clean, "items struct<instruction:string,output:string>", {"mode": "PERMISSIVE"})["items"]
    none = F.array().cast("array<struct<instruction:string,output:string>>")
    is_list = F.coalesce(F.get_json_object(clean, "$.items").startswith("["), F.lit(False))
    is_object = F.coalesce(F.get_json_object(clean, "$.items").startswith("{"), F.lit(False))
    return F.coalesce(F.when(is_list, F.filter(many, lambda s: s.isNotNull())).when(is_object, F.array(one)), none)


def split_key(topic: Column, instruction: Column, task: str = "assistant_qa") -> Column:
    return F.sha1(F.concat(F.lit(task + ":"), topic, F.lit(":"), F.lower(instruction)))
