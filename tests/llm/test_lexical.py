"""Op 12 against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import lexical
from millrace.llm.queries import ORACLE_SQL, op12_lexical_search
from tests.compare import duck, of_duck, of_spark
from tests.llm.helpers import clashing, docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items, k=10):
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in documents)]
    n, total = sum(length > 0 for _, _, length in held), sum(length for _, _, length in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in held:
            m = 100 - 75 + (75 * length * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("block", "segment", "query_words"), [(32, 2048, 2_000_000), (2, 7, 12)])
def test_like_plain_scores(spark, monkeypatch, block, segment, query_words):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.paretovariate(0.4)), 300)}"
    texts = [" ".join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.choice([0, 1, 5, 20, 60]))) for _ in range(150)]
    texts += texts[:20] + [None, "", "...", "é É w1-w2_w3"]
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9])))) for i in range(30)] + [(30, None), (31, "nowhere"), (32, "é w1 w1 w1")]
    found = lexical.rank(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), query_words=query_words)
    assert got(found) == brute(list(enumerate(texts)), items)


def test_blocks_below_the_threshold_are_not_scored():
    import numpy as np

    present, most = lexical.block_maxima(np.array([0, 0, 1, 2]), np.array([5, 9, 5, 5]), np.array([3, 4, 8, 1]), 3)
    assert present.tolist() == [5, 9] and most.tolist() == [[3, 4], [8, 0], [1, 0]]


def test_ties_repeats_nulls_and_odd_columns(spark):
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), (3, "a b"), (4, "a b c"), (5, "x"), (6, None), (8, " "), (9, "a " * 50_000)]
    items = [("x1", "a b"), (None, "c"), ("x1", "A"), ("y", ""), ("z", None)]
    base = docs(spark, []).select("text", "lang", "source", "n_chars")
    df = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    bench = clashing(spark.createDataFrame(items, "item_id string, text string"))
    assert base.columns and got(lexical.rank(df, bench)) == brute(rows, items)
    assert got(lexical.rank(df.limit(0), bench)) == [] and got(lexical.rank(df, bench.limit(0))) == []
    assert lexical.rank(odd_docs(spark), bench).count() > 0


def test_string_ids_of_documents(spark):
    df = spark.createDataFrame([("b", "q r"), ("a", "q r"), (None, "q r"), ("c", "s")], "doc_id string, text string")
    bench = spark.createDataFrame([(1, "q")], "item_id int, text string")
    assert [(r.rank, r.doc_id) for r in lexical.rank(df, bench).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_query_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert of_spark(op12_lexical_search(spark, sf)) == of_duck(duck(sf), ORACLE_SQL["op12_lexical_search"])
