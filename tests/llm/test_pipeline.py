"""The pipeline on a small corpus whose every row's fate is known, and on the smallest tables."""

import random

import corpus_pipeline
from tests.llm.helpers import DOCS, odd_docs


def planted(spark, tmp_path):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    passage = " ".join(word() for _ in range(20))
    rows, labels = [], []
    for i in range(0, 240):
        words = [word() for _ in range(120)]
        if i % 8 == 1:  # toxic
            for _ in range(5):
                words[rng.randrange(120)] = rng.choice(["vile", "foul", "nasty"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 8 == 1)))
    clean = [r for r in rows if r[0] % 8 != 1]
    rows += [(1000 + k, r[1], "en", "s", 0) for k, r in enumerate(clean[:5])]  # exact copies
    rows += [(2000 + k, r[1] + " at the end", "en", "s", 0) for k, r in enumerate(clean[5:10])]  # near copies
    rows += [(3000 + k, " ".join(word() for _ in range(50)) + " " + passage + " end", "en", "s", 0) for k in range(3)]
    rows += [(4000, "write to me@example.com or " + " ".join(word() for _ in range(30)), "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {r[0] for r in clean} | {4000}


def test_stages(spark, tmp_path):
    want = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == want
    assert kept[4000].startswith("write to <EMAIL> or ")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_odd_rows_pass_every_stage(spark, tmp_path):
    planted(spark, tmp_path)
    for empty in (False, True):
        docs = odd_docs(spark).limit(0) if empty else odd_docs(spark)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert (docs.count() == 0) is empty


def test_smallest_tables(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
