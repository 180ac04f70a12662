"""Op 6 against item-by-item best fit."""

import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from millrace.llm import packing
from tests.llm.helpers import clashing, docs, odd_docs


def one_by_one(lengths, sizes):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n]
        if fitting:
            b = bins[min(fitting)[1]]
        else:
            b = {"room": packing.opening(n, sizes), "items": []}
            bins.append(b)
        b["room"] -= n
        b["items"].append(n)
    return Counter((tuple(b["items"]), min(s for s in sizes if s >= sum(b["items"]))) for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    sizes = (16, 32, 64)
    lengths = [rng.choice([1, 2, 3, 5, 9, 16, 17, 30, 33, 64]) for _ in range(rng.choice([1, 10, 200]))]
    made = packing.plan(Counter(lengths), sizes)
    held = defaultdict(list)
    ends = {}
    for length, rank, first, each, offset in sorted(made.entries, reverse=True):
        n = Counter(lengths)[length]
        following = [e[1] for e in made.entries if e[0] == length and e[1] > rank]
        for k in range((min(following) if following else n) - rank):
            held[first + k // each].append((offset + k % each * length, length))
    for first, count, fill, size in made.bins:
        for b in range(first, first + count):
            at = 0
            for offset, length in sorted(held[b]):
                assert offset == at
                at += length
            assert at == fill <= size
            ends[b] = size
    got = Counter((tuple(n for _, n in sorted(items)), ends[b]) for b, items in held.items())
    assert got == one_by_one(lengths, sizes)


def test_bins_hold_every_token_once(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.choice([0, 1, 10, 10, 500, 4096, 5000, 9000])) for _ in range(80)]
    got = packing.pack_documents(docs(spark, texts)).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({i: len(t.split()) for i, t in enumerate(texts)})
    bins = defaultdict(list)
    for r in got:
        if r.n_tokens:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_size))
        else:
            assert r.bin_id is None
    for items in bins.values():
        at = 0
        for offset, n, _ in sorted(items):
            assert offset == at
            at += n
        assert {s for *_, s in items} == {min(s for s in packing.SIZES if s >= at)}


def test_odd_and_empty(spark):
    odd = clashing(odd_docs(spark))
    got = packing.pack_documents(odd).collect()
    assert sum(r.n_tokens for r in got) == 7 * 3 + 60_000 + 1 + 4
    assert {r.doc_id for r in got if r.bin_id is None} == {1, 2, 3}
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_many_items_of_a_length_take_more_salts(spark, monkeypatch):
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(300).alias("n_tokens"))
    few = sorted((r.bin_id, r.bin_offset) for r in packing.pack(items).collect())
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    many = sorted((r.bin_id, r.bin_offset) for r in packing.pack(items).collect())
    assert few == many and len(set(many)) == 3000
