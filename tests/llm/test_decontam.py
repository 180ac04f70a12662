"""Op 10 against a search for every window, and against SQL."""

import random
import re

import pytest

from millrace.llm import decontam
from millrace.llm.queries import ORACLE_SQL, op10_decontamination
from tests.compare import duck, of_duck, of_spark
from tests.llm.helpers import clashing, docs, odd_docs


def test_query_like_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert of_spark(op10_decontamination(spark, sf)) == of_duck(duck(sf), ORACLE_SQL["op10_decontamination"])


def split(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(text, items, window):
    words, hit, found = split(text), set(), set()
    for item, t in items:
        ids = split(t)
        for i in range(max(1, len(ids) - window + 1)) if ids else ():
            w = ids[i : i + window]
            for s in range(len(words) - len(w) + 1):
                if words[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(item)
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_words", [1, 30, 10**6])
def test_like_a_search(spark, block_words):
    rng = random.Random(2)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["Alpha", "be", "to", "or", "not", "é1"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 6, 9]))) for i in range(12)] + [(20, None), (21, "to be or")]
    texts = [text(rng.choice([0, 3, 40])) for _ in range(30)] + [None, items[5][1], "to-be/or"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find(docs(spark, texts), bench, window=4, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        n, hit, found = slow(t, items, 4)
        r = got[i]
        assert (r.n_words, sorted(r["items"])) == (n, found)
        assert {k for a, b in zip(r.starts, r.ends, strict=True) for k in range(a, b)} == hit


def test_repeated_rows_over_several_passes(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    odd = odd_docs(spark).repartition(3)
    got = decontam.find(odd, bench, window=3, block_words=1).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in odd.collect())
    assert {(r.doc_id, tuple(r["items"]), tuple(r.starts), tuple(r.ends)) for r in got if r["items"]} == {(i, (1, 2), (0,), (6,)) for i in (4, 5)}


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta delta")], "item_id long, text string")
    texts = ["gamma x alpha y beta", "alpha beta x x x x gamma", "delta x delta", "delta x"]
    got = {r.doc_id: r["items"] for r in decontam.find(docs(spark, texts), bench, proximity=2).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: []}


def test_odd_and_empty(spark):
    bench = spark.createDataFrame([(1, "c d e"), (1, "c d e"), (2, None), (None, "a b")], "item_id long, text string")
    odd = clashing(odd_docs(spark))
    got = decontam.digest(odd, bench).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.contaminated} == {4, 5}
    assert not any(r.contaminated for r in decontam.digest(odd, bench.limit(0)).collect())
    assert decontam.digest(odd.limit(0), bench).count() == 0
    assert {r.doc_id for r in decontam.drop_contaminated(odd, bench).collect()} == {1, 2, 3, 6, 7, 8}


def test_drop_tells_rows_apart(spark):
    bench = spark.createDataFrame([(1, "c d e")], "item_id long, text string")
    rows = [(None, "b c d e"), (None, "clean"), (7, "c d e f"), (7, "clean"), (7, None), (8, "ü" * 40)]
    for blocks_of in (bench, bench.union(spark.createDataFrame([(2, "zz yy")], bench.schema))):
        kept = decontam.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), blocks_of).collect()
        assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame([rows[i] for i in (1, 3, 4, 5)], "doc_id long, text string").collect())


@pytest.mark.parametrize("block_words", [1, 10**6])
def test_items_without_an_id_count(spark, block_words):
    bench = spark.createDataFrame([(None, "a b c"), (1, "x y z")], "item_id long, text string")
    texts = ["so a b c it is", "x y z a b c", "clean"]
    got = {r.doc_id: (sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), r["items"]) for r in decontam.find(docs(spark, texts), bench, block_words=block_words).collect()}
    assert got == {0: (3, []), 1: (6, [1]), 2: (0, [])}
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.digest(docs(spark, texts), bench).collect()} == {0: (3, 0, True), 1: (6, 1, True), 2: (0, 0, False)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs(spark, texts), bench).collect()] == [2]


def slow_near(text, items, window, slop):
    words, hit, found = split(text), set(), set()
    for item, t in items:
        ids = split(t)
        for i in range(max(1, len(ids) - window + 1)) if ids else ():
            w = ids[i : i + window]
            for s in range(len(words)):
                part = words[s : s + len(w) + slop]
                if words[s] in w and all(part.count(x) >= w.count(x) for x in w):
                    hit |= set(range(s, s + len(part)))
                    found.add(item)
    return hit, sorted(found)


@pytest.mark.parametrize("block_words, postings", [(20, 1 << 19), (10**6, 1), (10**6, 1 << 19)])
def test_near_like_a_search(spark, monkeypatch, block_words, postings):
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 7]))) for i in range(10)]
    texts = [text(rng.choice([0, 2, 5, 30])) for _ in range(40)] + [None, items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find(docs(spark, texts), bench, window=4, proximity=1, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        hit, found = slow_near(t, items, 4, 1)
        assert {k for a, b in zip(got[i].starts, got[i].ends, strict=True) for k in range(a, b)} == hit
        assert sorted(got[i]["items"]) == found
    assert any(slow_near(t, items, 4, 1)[1] != slow(t, items, 4)[2] for t in texts)


def test_query_tells_near_items(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (None, "u v w")], "item_id long, text string")
    texts = ["a b c x d e f g h j i y", "a b c x x x d e f g h i j", "v w u"]
    got = {r.doc_id: (r.n_items, r.n_near, r.contaminated) for r in decontam.digest(docs(spark, texts), bench).collect()}
    assert got == {0: (0, 1, False), 1: (0, 0, False), 2: (0, 0, False)}


def test_items_with_ids_of_any_type(spark):
    words = " ".join(f"w{i}" for i in range(14))
    df = docs(spark, [f"see {words} here", "nothing here", None])
    for kind, ids in (("string", ["x1", "y", None]), ("int", [7, 3, None]), ("date", [__import__("datetime").date(2020, 1, 1), __import__("datetime").date(2019, 1, 1), None])):
        bench = spark.createDataFrame([(ids[0], words), (ids[1], words), (ids[0], words[3:]), (ids[2], words)], f"item_id {kind}, text string")
        for block_words in (2_000_000, 20):
            found = {r.doc_id: r for r in decontam.find(df, bench, block_words=block_words).collect()}
            assert sorted(map(str, found[0]["items"])) == sorted(map(str, ids[:2])) and found[1]["items"] == [] and found[2]["items"] == []
        told = {r.doc_id: r for r in decontam.digest(df, bench).collect()}
        assert (told[0].n_items, told[0].n_hit, told[0].contaminated) == (2, 14, True) and told[1].n_items == 0
