"""Op 2: held-out accuracy, filters and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.queries import op2_langid
from tests.llm.helpers import clashing, odd_docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op2_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right >= 0.98


def test_filter_holds_its_members():
    rng = np.random.default_rng(0)
    for n_languages in (2, 9, 20, 64, 70, 130):
        members = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(n_languages)]
        model = langid.BitSlicedFilter([f"l{i}" for i in range(n_languages)], members)
        for i, own in enumerate(members):
            assert model.popcounts(own)[i] == 500
        assert (model.popcounts(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)) < 20).all()


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "Das ist, ein Text  mit ÄÖÜ 12 und so -- weiter. " * 40
    whole = np.concatenate(list(langid.grams(text)))
    for size in (5, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert (np.concatenate(list(langid.grams(text))) == whole).all()


def test_letters_and_nothing_else_count():
    same = lambda a, b: np.array_equal(np.concatenate(list(langid.grams(a))), np.concatenate(list(langid.grams(b))))
    assert same("Hello, World!!", "hello 42 world")
    assert list(langid.grams(None)) == [] and list(langid.grams("")) == []


def test_odd_and_empty(spark):
    odd = clashing(odd_docs(spark))
    model = langid.fit(odd, F.lit(True))
    got = {r.id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].lang_pred in ("en", "fr")
    nothing = langid.fit(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_like_plain_sets(spark):
    """The filters against sets of the same n-grams, counted one by one."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [r for r in rows if r[0] % 3]
    every = lambda t: [int(x) for part in langid.grams(t) for x in part]
    languages = sorted({r[2] for r in train if r[2]}, key=lambda x: (-sum(r[2] == x for r in train), x))
    held = {}
    for lang in languages:
        often = {}
        for r in train:
            if r[2] == lang:
                for g in set(every(r[1])):
                    often[g] = often.get(g, 0) + 1
        held[lang] = {g for g, n in often.items() if n > 1}
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(df, F.col("doc_id") % 3 != 0)
    assert model.languages == languages
    got = {r.id: r for r in langid.identify(df, model).collect()}
    for doc_id, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert got[doc_id].lang_pred == "und"
            continue
        found = every(text)
        counts = [sum(g in held[lang] for g in found) for lang in languages]
        share = max(counts) / sum(counts) if sum(counts) else 0
        assert abs(got[doc_id].score - share) < 0.02
        if sorted(counts)[-1] > 1.05 * sorted(counts)[-2] + 2:
            assert got[doc_id].lang_pred == languages[counts.index(max(counts))]


def test_more_languages_than_bits(spark):
    rng = np.random.default_rng(1)
    words = {f"l{i:03d}": "".join(chr(97 + k) for k in rng.integers(0, 26, 12)) for i in range(90)}
    rows = [(3 * k + j, f"{w} {w[::-1]} {w}", lang) for k, (lang, w) in enumerate(words.items()) for j in (0, 2)] + [(None, "abc", "zz"), (500_001, words["l077"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) >= 0)
    assert len(model.languages) == 90 and len(model.tables) == 2
    got = {r.id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[500_001] == "l077" and sum(got[i] == lang for i, _, lang in rows if lang and i is not None) >= 176


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "wie geht es", "de"), (1, "wie geht es", "de"), (2, "", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, (r.held_out for r in op2_langid(spark, str(tmp_path)).collect() if r.doc_id is None))) == ["False"]
