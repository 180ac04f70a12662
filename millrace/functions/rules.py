"""Rules for instruction/answer pairs. Each takes columns and gives a boolean; texts come with single spaces."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import let
from millrace.functions.text import strip, word_count, words

# The word lists of the rules.
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
PHRASE_VERBS = (*SLOT_VERBS, "can", "will", "should")
PUNCTUATION = r'[.!?,:;"()]'
MODE_REFUSALS = ("i don't know", "i do not know", "i cannot", "i can't", "not sure", "i'm not sure", "sorry", "as an ai", "no idea")


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts), F.lit(False))


def starts_with_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, (F.startswith(text, F.lit(p)) for p in parts), F.lit(False))


def has_word(text: Column, listed: Iterable[str]) -> Column:
    return text.rlike(r"\b(" + "|".join(listed) + r")\b")


def near_repeat(text: Column, least_words: int = 0) -> Column:
    """A word that equals the next or the one after it; the last two words are not compared with each other."""

    def repeats(found: Column) -> Column:
        n = F.size(found)
        at = F.when(n >= max(3, least_words), F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.exists(at, lambda k: (F.get(found, k - 1) == F.get(found, k)) | (F.get(found, k - 1) == F.get(found, k + 1)))

    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), repeats)  # not found anew at each place


def non_empty(instruction: Column, output: Column) -> Column:
    return F.coalesce((strip(instruction) != "") & (strip(output) != ""), F.lit(False))


def common(instruction: Column, output: Column, brands: Iterable[str] = ()) -> Column:
    low = F.lower(output)
    n = word_count(instruction)
    clean = ~contains_any(F.lower(instruction), brands) & ~contains_any(low, brands)
    return non_empty(instruction, output) & (n >= 3) & (n <= 40) & ~F.endswith(output, F.lit("?")) & clean & ~contains_any(low, REFUSALS)


def _plain_answer(output: Column, least: int, most: int) -> Column:
    """So many words, not starting with the letters of yes or no."""
    n = word_count(output)
    return (n >= least) & (n <= most) & ~starts_with_any(F.lower(output), ("yes", "no"))


def factoid(instruction: Column, output: Column) -> Column:
    return starts_with_any(F.lower(instruction), FACTOID_STARTS) & _plain_answer(output, 2, 18)


def reason_topics(instruction: Column, output: Column, phrases: Iterable[str] = REASON_PHRASES) -> Column:
    low = F.lower(instruction)
    return ~F.startswith(low, F.lit("how to ")) & ~contains_any(low, REASON_TOPICS) & ~contains_any(F.lower(output), phrases)


def reason(instruction: Column, output: Column) -> Column:
    return starts_with_any(F.lower(instruction), REASON_STARTS) & _plain_answer(output, 6, 28) & reason_topics(instruction, output) & ~near_repeat(output, 6)


def reason_again(instruction: Column, output: Column) -> Column:
    """The rules that how/why pairs pass once more when topics are merged."""
    return reason_topics(instruction, output, REASON_PHRASES[:-1]) & ~near_repeat(output)


def slot(instruction: Column, output: Column) -> Column:
    low = F.lower(instruction)
    stated = contains_any(low, [" " + p for p in FACT_PHRASES]) | starts_with_any(low, FACT_PHRASES)
    return stated & _plain_answer(output, 1, 4) & ~output.rlike(PUNCTUATION) & ~has_word(F.lower(output), SLOT_VERBS)


def form(instruction: Column, output: Column) -> Column:
    low, n = F.lower(instruction), word_count(output)
    plain = ~output.rlike(PUNCTUATION)
    checks = {
        FORM_TAGS[0]: (n == 1) & plain,
        FORM_TAGS[1]: (n >= 1) & (n <= 4) & plain & ~has_word(F.lower(output), PHRASE_VERBS),
        FORM_TAGS[2]: (n >= 4) & (n <= 10) & ~output.rlike("[?!]"),
    }
    each = reduce(and_, (~F.contains(low, F.lit(tag)) | ok for tag, ok in checks.items()))
    return contains_any(low, FORM_TAGS) & ~contains_any(F.lower(output), FORM_PHRASES) & each


#: Topic and rule of each kind of pair, in the order in which topics are merged.
KINDS = {"factoid_short": factoid, "how_why_short": reason, "slot_following": slot, "short_form_answer": form}


def answers(text: Column, brands: Iterable[str] = ()) -> Column:
    """Whether a reply answers: 1 to 80 words, not starting with the word yes or no or a brand, no refusal."""
    brands = tuple(brands)
    n = word_count(text)
    first = F.regexp_replace(F.lower(F.get(words(text), F.lit(0))), r"^[.,!?;:]+|[.,!?;:]+$", "")
    return F.coalesce((n >= 1) & (n <= 80) & ~first.isin("yes", "no", *brands) & ~contains_any(F.lower(strip(text)), (*brands, *MODE_REFUSALS)), F.lit(False))
