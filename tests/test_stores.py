"""Tensor files, versions and listings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, tensors, versions


def plain_file(path, parts):
    at, head, body = 0, {"__metadata__": {"x": "y"}}, b""
    for name, x in parts.items():
        head[name] = {"dtype": {"float32": "F32", "int64": "I64", "float64": "F64"}[str(x.dtype)], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at, body = at + x.nbytes, body + x.tobytes()
    text = json.dumps(head).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + body)


def test_blocks_of_tensors(spark, tmp_path):
    parts = {"a.weight": np.arange(10, dtype=np.float32).reshape(2, 5), "b": np.array(7, dtype=np.int64), "c": np.zeros((0, 3)), "d.A": np.arange(3.0)}
    plain_file(tmp_path / "x.safetensors", parts)
    got = sorted((r.name, r.start, r.values) for r in tensors.read_tensors(spark, str(tmp_path), 4).collect())
    assert got == [("a.weight", 0, [0, 1, 2, 3]), ("a.weight", 4, [4, 5, 6, 7]), ("a.weight", 8, [8, 9]), ("b", 0, [7]), ("c", 0, []), ("d.A", 0, [0, 1, 2])]
    heads = tensors.read_tensors(spark, str(tmp_path), values=False)
    assert tuple(tensors.parameter_counts(heads, tensors.is_adapter(F.col("name"))).first()) == (14, 3, 100 * 3 / 14)
    assert tuple(tensors.parameter_counts(heads.limit(0), tensors.is_adapter(F.col("name"), True)).first()) == (0, 0, 0.0)


def test_written_tensors(spark, tmp_path):
    rows = [("f", 'we"ird.B', [2, 2], 2, [3.0, 4.0]), ("f", 'we"ird.B', [2, 2], 0, [1.0, 2.0]), ("f", "a", [3], 0, [5.0, 6.0, 7.0]), ("g", "a", [1], 0, [8.0])]
    tensors.write_tensors(spark.createDataFrame(rows, "file string, name string, shape array<long>, start long, values array<double>"), f"{tmp_path}/t")
    got = sorted((r.path[-13:], r.name, list(r.shape), r.values) for r in tensors.read_tensors(spark, f"{tmp_path}/t").collect())
    assert got == [("f.safetensors", "a", [3], [5, 6, 7]), ("f.safetensors", 'we"ird.B', [2, 2], [1, 2, 3, 4]), ("g.safetensors", "a", [1], [8])]


def test_layouts_of_a_module(spark):
    names = [("p", "projector.w"), ("p", "other"), ("q", "model.projector.x"), ("q", "projector.w"), ("s", "model.projector.w"), ("s", "w2"), ("r", "w")]
    df = spark.createDataFrame(names, "path string, name string")
    assert sorted(map(tuple, tensors.of_module(df, "projector").select("path", "name").collect())) == [("p", "w"), ("q", "w"), ("r", "w"), ("s", "w")]


def test_a_commit_may_break_off_anywhere(spark, tmp_path):
    path, table = f"{tmp_path}/v", lambda n: spark.range(n).coalesce(1)
    with pytest.raises(FileNotFoundError):
        versions.read_latest(spark, path)
    assert versions.commit(table(1), path) == 0
    n = len(list(versions.commit_steps(table(2), path)))
    assert n == 4 and versions.read_latest(spark, path).count() == 2
    rows = 2
    for stop in range(1, n + 1):
        steps = versions.commit_steps(table(rows + 1), path)
        for _ in range(stop):
            next(steps)
        rows += stop > 1  # from its second step on the new version counts
        assert versions.read_latest(spark, path).count() == rows
        versions.commit(table(rows), path)
        assert len(versions.versions(spark, path)) == 1 and len([p for p in (tmp_path / "v").iterdir() if p.name.startswith("version-")]) == 1
    for k in range(3):
        versions.commit(table(k), path, keep=2)
    assert len(versions.versions(spark, path)) == 2


def test_rows_with_and_without_a_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.jpg").write_bytes(b"xy")
    (tmp_path / "d" / "b.jpg").write_bytes(b"z")
    (tmp_path / "e.jpg").write_bytes(b"")
    files = readers.listing(spark, str(tmp_path), "*.jpg")
    assert sorted((r.name, r["size"]) for r in files.collect()) == [("a.jpg", 2), ("b.jpg", 1)]
    rows = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",), (None,), ("a.jpg",)], "fn string")
    assert sorted(r.fn for r in readers.with_files(rows, files, "fn").collect()) == ["a.jpg", "a.jpg", "b.jpg"]
    assert sorted(map(str, (r.fn for r in readers.without_files(rows, files, "fn").collect()))) == ["None", "c.jpg"]


def test_prompts_end_at_the_first_word_that_says_so(spark):
    rows = [(0, None, " hi "), (1, ' "a.jpg" ', "what"), (2, "gone.jpg", "what"), (3, "a.jpg", "  "), (4, "'a.jpg'", "x"), (5, " Exit", "y"), (6, "", "late"), (7, "quit", "z")]
    df = spark.createDataFrame(rows, "ordinal long, image string, text string")
    images = spark.createDataFrame([("a.jpg",)], "name string")
    assert sorted(map(tuple, readers.prompts(df, images).collect())) == [(0, "", "hi"), (1, "a.jpg", "what"), (4, "a.jpg", "x")]
    assert sorted(r.ordinal for r in readers.prompts(df.where("ordinal not in (5, 7)"), images).collect()) == [0, 1, 4, 6]


def test_small_blocks_share_tasks(spark, tmp_path):
    values = np.arange(6001, dtype=np.float32)
    plain_file(tmp_path / "x.safetensors", {"a": values, "b": values[:5]})
    df = tensors.read_tensors(spark, str(tmp_path), 4)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = sorted((r.name, r.start, r.values) for r in df.collect())
    assert got == [("a", k, values[k : k + 4].tolist()) for k in range(0, 6001, 4)] + [("b", 0, [0, 1, 2, 3]), ("b", 4, [4])]
