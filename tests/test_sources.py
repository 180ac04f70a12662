"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import arrays, readers, shards
from millrace.streaming.dedup import stored, stream_new_rows


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n")
    assert [(r.line_no, r.text) for r in readers.lines(spark, str(tmp_path)).orderBy("path", "line_no").collect()] == [(0, "one\n"), (1, "two\n"), (0, "three\n")]
    assert readers.lines(spark, str(tmp_path), 2).count() == 2


def test_separated_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nx<|endoftext|>two<|endoftext|>")
    assert sorted(r.text for r in readers.separated_texts(spark, str(tmp_path)).collect()) == ["one\nx", "two"]


def test_invalid_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"a\xffb\xe2\x82")
    assert readers.texts_ignoring_errors(spark, str(tmp_path)).first().text == "ab"


def test_parquet_split_by_file(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"t{k}", k)], "text string, other int").write.parquet(str(tmp_path / f"d/part{k}.parquet"))
    found = readers.parquet_texts(spark, str(tmp_path / "d/*"))
    assert {r.text: r.split for r in readers.split_by_file(found, 2).collect()} == {"t0": "train", "t1": "train", "t2": "valid"}


def test_jsonl(spark, tmp_path):
    lines = ['{"instruction": " a ", "output": "b"}', "", "{bad", "[1]", '{"instruction": null, "output": "x"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = readers.tolerant_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [tuple(r) for r in got] == [("a", "b", ""), ("", "x", "")]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "instruction string, output string").collect()
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert [r.x for r in readers.json_array(spark, str(tmp_path / "b.json")).collect()] == [1, 2]


def test_captions(spark, tmp_path):
    (tmp_path / "c.csv").write_text('raw,split,filename,img_id\n"[""a ""\n, ""b""]",train,1.jpg,7\n"[""x""]",none,2.jpg,8\n')
    got = readers.captions(spark, str(tmp_path / "c.csv"), "img").orderBy("caption_index").collect()
    assert [(r.fn, r.caption_index, r.output) for r in got] == [("img/1.jpg", 0, "a"), ("img/1.jpg", 1, "b")]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = {f"{k}.txt": [f"{i} " + "x" * int(rng.integers(0, 90)) for i in range(n)] for k, n in enumerate((900, 0, 1, 300))}
    for name, own in texts.items():
        (tmp_path / name).write_text("".join(t + "\n" for t in own))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = readers.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((r.path[-5:], r.line_no, r.text) for r in found.collect())
        first = readers.lines(spark, str(tmp_path), 902).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, i, t + "\n") for name, own in texts.items() for i, t in enumerate(own)]
    assert got == sorted(want) and sorted((r.path[-5:], r.line_no, r.text) for r in first) == sorted(want[:902])


def test_completions_replay(spark):
    asked = readers.requests(spark, 3, ["ask {n}", "fail"], 5)
    answers = readers.completions(asked, lambda p: '{"items": [{"instruction": "%s", "output": "y"}]}' % p if p != "fail" else 1 / 0)
    assert [(r.ordinal, r.instruction) for r in readers.answered_pairs(answers).orderBy("ordinal").collect()] == [(0, "ask 5"), (2000000, "ask 5")]


def test_shards(spark, tmp_path):
    rows = [("train", 0, 1, [3, 4]), ("train", 0, 0, [1, 2]), ("valid", 0, 0, [9])]
    tokens = spark.createDataFrame(rows, "split string, shard_id int, seq_no long, token_ids array<int>")
    shards.write_shards(tokens, str(tmp_path / "t"))
    assert shards.read_shards(spark, str(tmp_path / "t")).count() == 3
    arrays.write_npy(tokens, str(tmp_path / "npy"), 300, "own")
    assert sorted(p.name for p in (tmp_path / "npy").iterdir()) == ["own-train-all-shard0.npy", "own-valid-all-shard0.npy"]
    whole = np.load(tmp_path / "npy/own-train-all-shard0.npy")
    assert whole.dtype == np.uint16 and whole.tolist() == [1, 2, 3, 4]
    got = sorted((r.split, r.shard_id, r.start, r.token_ids) for r in arrays.read_npy(spark, str(tmp_path / "npy"), 3, 2).collect())
    assert got == [("train", 0, 0, [1, 2]), ("train", 0, 2, [3]), ("train", 0, 3, [4]), ("valid", 0, 0, [9])]


def test_array_files_of_others_and_none(spark, tmp_path):
    np.save(tmp_path / "x-train-5-shard3.npy", np.arange(70_000, 70_010, dtype=np.uint32))
    np.save(tmp_path / "x-valid-5-shard4.npy", np.zeros(0, dtype=np.uint16))
    got = {(r.split, r.shard_id): r.token_ids for r in arrays.read_npy(spark, str(tmp_path)).collect()}
    assert got == {("train", 3): list(range(70_000, 70_010)), ("valid", 4): []}
    with pytest.raises(Exception, match="no token shards"):
        arrays.read_npy(spark, str(tmp_path / "none")).collect()


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = spark.createDataFrame([("train", 0, 0, [1])], "split string, shard_id int, seq_no long, token_ids array<int>").withColumn("token_ids", F.transform("token_ids", lambda i: F.raise_error(F.lit("broken")).cast("int")))
    with pytest.raises(Exception, match="broken"):
        arrays.write_npy(bad, str(tmp_path / "npy"), 300)
    assert list(tmp_path.rglob("*.npy")) == []


def test_overwrite_jsonl(spark, tmp_path):
    path = f"{tmp_path}/x"
    spark.range(3).write.json(path)
    shards.overwrite_jsonl(spark.read.json(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [1, 2]


def test_stream_resumes(spark, tmp_path):
    source, table, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "k string, at long"
    for rows in ([("a", 1), ("b", 2), ("a", 0)], [("a", 3), ("c", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_new_rows(spark.readStream.schema(schema).parquet(source), table, state, "k", "at").awaitTermination()
    got = stored(spark, table, spark.createDataFrame([], schema))
    assert sorted((r.k, r.at) for r in got.select("k", "at").collect()) == [("a", 0), ("b", 2), ("c", 4)]


def test_metrics(spark):
    assert shards.metrics("r", 3, {"loss": 1.5, "acc": 0.5}, spark).select(F.sum("value")).first()[0] == 2.0


def test_small_ranges_of_arrays_share_tasks(spark, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"x-train-5-shard{k}.npy", np.arange(k, 5000 + k, dtype=np.uint16))
    df = arrays.read_npy(spark, str(tmp_path), 14, 7)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = sorted((r.shard_id, r.start, r.token_ids) for r in df.collect())
    assert got == [(k, a, list(range(a + k, min(a + 7, 5000) + k))) for k in range(3) for a in range(0, 5000, 7)]


def test_errors_are_ignored_in_pieces_of_a_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = bytes(rng.choice([97, 32, 0xC3, 0xA9, 0x80, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98], 3000).astype(np.uint8)) + "é€😀".encode()[:-1]
    (tmp_path / "x").write_bytes(data)
    found = readers.texts_ignoring_errors(spark, str(tmp_path), 11).orderBy("start").collect()
    assert len(found) > 100
    assert "".join(r.text for r in found) == data.decode("utf-8", "ignore")


def test_each_of_six_files_is_a_task_of_its_own(spark, sf, tmp_path, monkeypatch):
    from millrace.plans import files

    monkeypatch.setattr(files, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert files.split_by_file(spark, sf).count() == 6
    names = [p.name for p in tmp_path.glob("files/file=*/part-*.parquet")]
    assert len({n[:10] for n in names}) == len(names) == 6
