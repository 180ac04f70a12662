"""Op 8: the suffix array against sorting, removal against a plain scan of all windows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffix_dedup
from tests.llm.helpers import clashing, odd_docs


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_dedup.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[0] * 500, [0, 1] * 300, [1, 0] * 300, list(range(300)), list(range(300))[::-1], [5, 0, 5, 0, 5, 9] * 50])
def test_suffix_array_of_regular_texts(symbols):
    assert suffix_dedup.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def scan(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(df, length):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df, length).collect()}


@pytest.mark.parametrize(("length", "letters", "chunk"), [(10, 2, 1 << 20), (12, 3, 64), (7, 2, 1 << 20), (25, 2, 100), (1, 2, 1 << 20)])
def test_removal_like_a_scan(spark, length, letters, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(length)
    base = "".join(rng.choice("abc"[:letters]) for _ in range(200))
    rows = []
    for i in range(70):
        at = rng.randint(0, 150)
        own = "".join(rng.choice("abé"[:letters]) for _ in range(rng.randint(0, 40)))
        rows.append((i, None if rng.random() < 0.05 else own + base[at : at + rng.randint(0, 60)] + rng.choice(["", "ab" * 20, "zz"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(df, length) == scan(rows, length)


def test_filter_that_is_full_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", 64)
    rows = [(i, f"{i} " + "the same passage in all of them, long enough to count " * 3 + f"{i * 7}") for i in range(20)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string"), 100) == scan(rows, 100)


def test_odd_and_empty(spark):
    odd = clashing(odd_docs(spark))
    got = digests(odd, 100)
    assert got[1] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert got[6][1:3] == (360_000 - len("lorem ipsum dolor "), 1)
    assert got[7][1:3] == (300_000 - 1, 1)
    assert suffix_dedup.digest(odd).count() == odd.count()
    assert suffix_dedup.digest(odd.limit(0)).count() == 0


def strict_scan(rows, length):
    """As ``scan`` for rows (order, text) that may share a place in the order: equal rows are one document, others of one place not earlier."""
    out = []
    for i, text in rows:
        data = (text or "").encode()
        windows = [data[s : s + length] for s in range(len(data) - length + 1)]
        before = {d[s : s + length] for j, t in rows if j < i for d in [(t or "").encode()] for s in range(len(d) - length + 1)}
        gone = bytearray(len(data))
        for s, w in enumerate(windows):
            if w in before or w in windows[:s]:
                gone[s : s + length] = b"\1" * length
        out.append((len(data), sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_that_share_an_id(spark, kind):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    x, y, z = text(120), text(120), text(60)
    rows = [(1, y), (3, y), (3, x), (2, z + x[:40] + z), (None, x), (None, z + y), (None, y[30:] + z), (5, x[10:70]), (5, x[10:70]), (4, y[:50] + x[50:]), (4, x[50:] + y[:50]), (4, None)]
    as_id = lambda i: i if i is None or kind == "long" else f"id{i}"
    df = spark.createDataFrame([(as_id(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(4)
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(df, 20).collect())
    assert got == strict_scan([(9 if i is None else i, t) for i, t in rows], 20)


def test_unique_text_of_a_shared_id_stays(spark):
    rng = random.Random(6)
    x, y = ("".join(rng.choice("abcdefghij ") for _ in range(560)) for _ in range(2))
    got = {(r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.digest(spark.createDataFrame([(1, y), (3, y), (3, x)], "doc_id long, text string")).collect()}
    assert got == {(1, 560), (3, 0), (3, 560)}
