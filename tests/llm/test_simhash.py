"""Op 1 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.common import connected_components, spanning
from tests.llm.helpers import DOCS, clashing, docs, odd_docs


def slow_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "One", "a b c", "A b\tC d", "ä Ä b\x0bc d e f g" * 30, "w " * 9000])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text, 4), "big") == slow_fingerprint(text, 4)


def test_wide_counts_like_narrow():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 100, 1000):
        rows = rng.integers(0, 1 << 63, (n, 5), dtype=np.uint64)
        assert (simhash.bit_counts(rows) == simhash.bits(rows).sum(axis=0)).all()


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(14):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "id long, fp binary")
    found = simhash.links(df, 4, 5, block=block)
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in found.collect())
    got = {r.node: r.component for r in connected_components(found).collect()}
    want = roots(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_documents(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            if copy and rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    prints = [slow_fingerprint(t, 4) for t in texts]
    want = roots(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.components(docs(spark, texts)).collect()
    assert {r.id: (int.from_bytes(r.fp, "big"), r.component) for r in got} == {i: (prints[i], want[i]) for i in want}


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(6)
    words = lambda: [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(10):
        own = words()
        near = list(own)
        near[150] = "changed"  # 5 of 296 shingles
        far = own[:150] + words()[:150]
        texts += [" ".join(own), " ".join(own), " ".join(near), " ".join(far)]
    kept = simhash.drop_near_duplicates(docs(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(0, 40, 4), *range(3, 40, 4)])


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 90)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 100: 90}


def test_spanning_reaches_all():
    edges = spanning(50, lambda i, left: np.abs(left - i) <= 2)
    assert len(edges) == 49 and all(abs(a - b) <= 2 for a, b in edges)


def test_odd_and_empty(spark):
    odd = clashing(odd_docs(spark))
    got = simhash.components(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.id: r for r in got}
    assert by_id[1].fp == by_id[2].fp == by_id[3].fp == bytes(8) and by_id[3].component == 1
    assert by_id[5].component == 4
    assert simhash.components(odd.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    assert {r.doc_id for r in simhash.drop_near_duplicates(odd).collect()} == {1, 4, 6, 7, 8}


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def test_near_duplicates_like_all_pairs(spark):
    """Similarities on both sides of 0.8, short texts among them: every link and no other."""
    rng = random.Random(3)
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 12, 20, 60, 300] * 3:
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        texts.append(" ".join(own))
        for _ in range(4):
            near = list(own)
            for _ in range(rng.randint(0, max(1, n // 30))):
                near[rng.choice([0, -1, rng.randrange(n)])] = f"v{rng.randint(0, 10**6)}"
            texts.append(" ".join(near if rng.random() < 0.5 else [*own, *(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 1 + n // 4)))]))
    sets = [shingles(t) for t in texts]
    want = roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == set(want.values())


def test_repeated_lines_do_not_make_near_duplicates(spark):
    rng = random.Random(9)
    body = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(500))
    line = " all rights are reserved by the owner of this page" * 50
    own = body()
    texts = [body() + line, body() + line, own, own + " " + " ".join(own.split()[:9] * 60)]
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()} == {0, 1, 2}


def test_one_row_of_each_group_stays(spark):
    """Null ids, repeated rows, and one id with two texts of which one is a copy."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(1, a, "en"), (None, b, "en"), (None, b, "fr"), (None, b.upper(), "en"), (2, c, "en"), (2, c, "en"), (3, a, "en"), (3, d, "en"), (4, e, "en"), (None, e, "en")]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    kept = [(r.doc_id, r.text.lower()) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (2, c), (3, d), (4, e)], key=str)


def test_parities_never_rule_out_alike_sets():
    rng = np.random.default_rng(2)
    for n in (5, 900, 1020, 2040, 5000):
        for extra in (0, 1, n // 4):
            a = np.unique(rng.integers(0, 1 << 63, n + extra, dtype=np.uint64))
            b = a[:n]
            sizes, differ = len(a) + len(b), len(a) - len(b)
            assert simhash.may_be_alike(simhash.wide_parities(a), simhash.wide_parities(b), sizes, simhash.Fraction(differ, sizes))
            far = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            assert n < 100 or not simhash.may_be_alike(simhash.wide_parities(a), simhash.wide_parities(far), sizes, simhash.Fraction(1, 9))


def test_null_and_string_ids(spark):
    a, b = ("x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6")
    rows = [(None, a), ("k2", a), ("k1", a), (None, b), (None, b)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.id), str(r.component)) for r in got) == [("None", "None"), ("None", "None"), ("None", "k1"), ("k1", "k1"), ("k2", "k1")]


def test_prefix_follows_one_order_for_all_sets():
    rng = np.random.default_rng(5)
    common = rng.permutation(np.arange(50, 80, dtype=np.uint64))
    rarity, place = simhash.Rarity(common), {int(h): k for k, h in enumerate(common)}
    for _ in range(30):
        s = np.unique(rng.integers(0, 120, 40).astype(np.uint64))
        want = sorted(s.tolist(), key=lambda h: (h in place, place.get(h, 0), h))
        n = len(s) - simhash.math.ceil(simhash.Fraction(4, 5) * len(s)) + 1
        assert rarity.prefix(s, simhash.Fraction(4, 5)).tolist() == want[:n]
