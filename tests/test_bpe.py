"""BPE against golden merges, a plain model of the rules and round trips."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import END
from millrace.operators import bpe, merges
from millrace.plans import corpus, examples


def words(counts):
    return [(list(w.encode()), n) for w, n in counts.items()]


def slow_merges(counts, k, tie):
    texts = [(list(w.encode()), n) for w, n in counts.items()]
    tokens = {i: bytes([i]) for i in range(256)}
    out = []
    for new in range(256, 256 + k):
        pairs = Counter()
        for ids, n in texts:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += n
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p if tie == "id" else (tokens[p[0]], tokens[p[1]])))
        tokens[new] = tokens[best[0]] + tokens[best[1]]
        out.append((*best, pairs[best]))
        texts = [(bpe.merge_pair(ids, best, new), n) for ids, n in texts]
    return out


@pytest.mark.parametrize("tie", ["id", "bytes"])
def test_golden_merges(tie):
    merges = bpe.train_merges(words({"low": 5, "lower": 2, "widest": 3, "newest": 6}), 8, tie)
    tokens = bpe.vocabulary(merges)
    assert [(tokens[a] + b"+" + tokens[b], n) for a, b, n in merges] == [(b"s+t", 9), (b"e+st", 9), (b"o+w", 7), (b"l+ow", 7), (b"w+est", 6), (b"n+e", 6), (b"ne+west", 6), (b"w+i", 3)]
    encoder = bpe.Encoder(tokens, merges)
    assert [tokens[i] for i in encoder.piece("widest")] == [b"wi", b"d", b"est"]


def test_tie_rules_differ():
    counts = {"ab": 3, "abc": 2, "xy": 2}
    assert bpe.train_merges(words(counts), 2, "bytes")[1][:2] == (120, 121)
    assert bpe.train_merges(words(counts), 2, "id")[1][:2] == (256, 99)


@pytest.mark.parametrize("tie", ["id", "bytes"])
def test_random_words_like_the_plain_model(tie):
    rng = random.Random(5)
    for _ in range(30):
        counts = Counter("".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(20))
        assert bpe.train_merges(words(counts), 12, tie) == slow_merges(counts, 12, tie)


def test_greedy_merge():
    assert bpe.merge_pair([97] * 5, (97, 97), 256) == [256, 256, 97]
    encoder = bpe.Encoder(bpe.vocabulary([(97, 97), (256, 97)]), [(97, 97), (256, 97)])
    assert encoder.piece("aaaaa") == [256, 257]


def test_round_trip(spark):
    docs = spark.createDataFrame([(0, "low lower <|endoftext|>newest é\n"), (1, ""), (2, None)], "doc_id int, text string")
    merges = bpe.train(docs, 270, specials=[END])
    tokens = bpe.vocabulary(merges, [END])
    coded = bpe.encode(docs, bpe.Encoder(tokens, merges, [END]))
    assert tokens[-1] == END.encode() and len(tokens) <= 270
    ids = {r.doc_id: r.ids for r in coded.collect()}
    assert ids[0].count(len(tokens) - 1) == 1 and ids[1] == [] and ids[2] == []
    back = {r.doc_id: r.text for r in bpe.decode(coded.drop("text"), tokens).collect()}
    assert back == {0: "low lower <|endoftext|>newest é\n", 1: "", 2: ""}


def test_invalid_bytes_are_replaced(spark):
    rows = spark.createDataFrame([([0xFF, 97],), ([0xE2, 0x82],), ([0xED, 0xA0, 0x80],)], "ids array<int>")
    got = [r.text for r in bpe.decode(rows, [bytes([i]) for i in range(256)]).collect()]
    assert got == [bytes(b).decode("utf-8", "replace") for b in ([0xFF, 97], [0xE2, 0x82], [0xED, 0xA0, 0x80])]


def test_counts_add_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = bpe.pretoken_counts(docs).agg(F.sum(F.col("freq") * F.length("pretoken"))).first()[0]
    assert counted == docs.agg(F.sum(F.length("text"))).first()[0]


def test_array_kinds():
    assert bpe.as_array([1], 65_535).dtype == "uint16" and bpe.as_array([1], 65_536).dtype == "uint32"


def test_byte_ids(spark):
    texts = ["aé", "", None, "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(bpe.byte_ids(F.col("s"))).collect()
    assert [r[0] for r in got] == [None if t is None else list(t.encode()) for t in texts]


def test_words_of_each_pair(spark):
    found = bpe.inverted_index(spark.createDataFrame([(0, [97, 97, 98]), (1, [97, 98, 99, 97, 98]), (2, [97]), (3, [])], "word_id int, ids array<int>"))
    assert sorted(map(tuple, found.collect())) == [(97, 97, 0), (97, 98, 0), (97, 98, 1), (98, 99, 1), (99, 97, 1)]


def test_pairs_that_may_be_merged_at_once():
    take = lambda *ranked, whole=True: merges.independent(ranked, whole)
    assert take((1, 2, 9), (1, 3, 8), (4, 2, 7)) == [(1, 2, 9), (1, 3, 8), (4, 2, 7)]
    assert take((1, 2, 9), (4, 5, 8), (2, 6, 7), (7, 8, 6)) == [(1, 2, 9), (4, 5, 8)]
    assert take((1, 2, 9), (4, 5, 7), (2, 6, 7)) == [(1, 2, 9)]
    assert take((1, 1, 9), (4, 5, 8)) == [(1, 1, 9)]
    assert take((4, 5, 9), (1, 1, 8), (6, 7, 7)) == [(4, 5, 9)]
    assert take((4, 5, 9), (6, 7, 9), whole=False) == [(4, 5, 9)]


def test_many_merges_at_once():
    import numpy as np

    words_ = [[1, 1, 1, 1, 1], [2, 3, 2], [], [3, 2, 3], [1], [1, 1], [5, 2, 3, 4]]
    flat, ends, changed = merges.merge_many(np.array(sum(words_, []), dtype=np.int32), np.cumsum([len(w) for w in words_]), {(1, 1): 90, (2, 3): 80})
    got = [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert got == [[90, 90, 1], [80, 2], [], [3, 80], [1], [90], [5, 80, 4]] and changed.tolist() == [True, True, False, True, False, True, True]


@pytest.mark.parametrize("seed", range(3))
def test_rounds_find_the_merges_of_one_at_a_time(spark, tmp_path, seed):
    rng = random.Random(seed)
    counts = Counter("".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 9))) for _ in range(60))
    table = bpe.as_words(spark.createDataFrame(list(counts.items()), "pretoken string, freq long"))
    want = slow_merges(counts, 25, "id")
    assert merges.train_rounds(table, 25, f"{tmp_path}/a") == want
    assert merges.train_rounds(table.limit(0), 5, f"{tmp_path}/b") == []


def test_counts_of_tokens_are_those_of_the_encoded_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the then the", "", None, "a the<|x|> the", "ab " * 50])], "doc_id long, text string").repartition(3)
    merges = bpe.train(docs, 262, ["<|x|>"])
    encoder = bpe.Encoder(bpe.vocabulary(merges, ["<|x|>"]), merges, ["<|x|>"])
    want = Counter(i for r in bpe.encode(docs, encoder).collect() for i in r.ids)
    found = bpe.token_counts(docs, encoder)
    assert {r.id: r.n for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_workers_keep_and_hold_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    encoder = bpe.Encoder(bpe.vocabulary([]), [])
    packed = bpe._Packed(encoder)
    assert [packed[f"{k}"] for k in range(50)] == [np.array(list(f"{k}".encode()), dtype=np.int32).tobytes() for k in range(50)]
    assert len(packed) == 10 and not encoder.cache
    lists = pa.array([[1, 2, 3], [], [4], [5, 6, 7, 8, 9], [10]], pa.list_(pa.int32())).slice(1)
    got = [(v.to_pylist(), b) for v, b in bpe.some_rows(lists, 3)]
    assert got == [([4], [0, 0, 1]), ([5, 6, 7, 8, 9], [0, 5]), ([10], [0, 1])]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with a table of 1,048,577 different words, five of each; the last of them in any order holds the most frequent pair."""
    place = str(tmp_path_factory.mktemp("many"))
    lines = spark.range(1 << 20).select((F.col("id") % 1024).alias("doc_id"), F.translate(F.lpad(F.hex("id"), 5, "0"), "0123456789ABCDEF", "abcdefghijklmnop").alias("w"))
    texts = lines.groupBy("doc_id").agg(F.repeat(F.concat(F.lit(" "), F.array_join(F.collect_list("w"), " ")), 5).alias("text"))
    longest = spark.range(5).select((F.col("id") + 1024).alias("doc_id"), F.repeat(F.lit("zq"), 70_001).alias("text"))
    texts.union(longest).coalesce(4).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("on_driver", [bpe.ON_DRIVER, 0])
def test_bpe_encode_trains_on_every_word(spark, many, monkeypatch, on_driver):
    monkeypatch.setattr(corpus, "VOCABULARY", 259)
    monkeypatch.setattr(bpe, "ON_DRIVER", on_driver)
    assert corpus._trained(spark, many) == [(122, 113, 350_005), (256, 256, 350_000)]
    if not on_driver:
        coded = corpus.bpe_encode(spark, many).where("doc_id >= 1024").collect()
        assert len(coded) == 5 and {r.n_tokens for r in coded} == {35_002}


def test_encode_from_files_trains_on_every_word(spark, many, monkeypatch):
    monkeypatch.setattr(corpus, "VOCABULARY", 259)
    coded = examples.encode_from_files(spark, many).where("doc_id >= 1024").collect()
    assert len(coded) == 5 and {r.n_tokens for r in coded} == {35_002}


def test_token_histogram_trains_on_every_word(spark, many, monkeypatch):
    monkeypatch.setattr(corpus, "VOCABULARY", 259)
    found = {r.id: r.n for r in corpus.token_histogram(spark, many).collect()}
    assert {k: n for k, n in found.items() if k >= 256 or k in b"zq"} == {258: 1029, 257: 175_000, 256: 5}
