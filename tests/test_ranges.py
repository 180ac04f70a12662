"""Byte ranges against cuts found by a plain search, and rounds of a stream against the batch operator."""

import io
import random
from collections import Counter

import pytest
import regex

from millrace.functions.text import PRETOKEN
from millrace.operators import instruct
from millrace.sources import ranges
from millrace.streaming import rounds


def plain_cuts(data, step, scan):
    out = {0, len(data)}
    for at in range(step, len(data), step):
        found = next((i for i in range(at, min(len(data), at + scan)) if data[i : i + 1] in (b" ", b"\n", b"\r", b"\t") and not data[:i].decode("utf-8", "ignore")[-1:].isspace()), None)
        if found is None:
            found = at
            while found < len(data) and data[found] & 0xC0 == 0x80:
                found += 1
        out.add(found)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_and_tokens(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = ["one", "zwölf", " ", "  ", "\n", "\n\n", " ", "日本語", "it's", "12", "!?", "\t x"]
    texts = ["".join(rng.choice(words) for _ in range(rng.choice([0, 1, 300, 900]))) for _ in range(4)] + ["é" * 400]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.txt").write_bytes(t.encode())
    (tmp_path / "_hidden").write_text("no")
    found = ranges.text_ranges(spark, str(tmp_path), step=97, scan=150).collect()
    cuts = {(r.path[-5:], r.cut) for r in ranges.cut_points(spark, str(tmp_path), 97, 150).collect()}
    for k, t in enumerate(texts):
        own = sorted((r.start, r.end, r.text) for r in found if r.path.endswith(f"/{k}.txt"))
        assert "".join(x[2] for x in own) == t
        if t:
            assert sorted(c for p, c in cuts if p == f"{k}.txt") == plain_cuts(t.encode(), 97, 150)
        if k < 4:
            assert Counter(p for x in own for p in regex.findall(PRETOKEN, x[2])) == Counter(regex.findall(PRETOKEN, t))


def candidates(spark, folder, rows):
    schema = "doc_id long, round long, text string"
    for k in range(0, len(rows), 25):
        spark.createDataFrame(rows[k : k + 25], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rounds_stop_resume_and_count_like_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i // 10, f"t{rng.randrange(60)}") for i in range(150)]
    stream = candidates(spark, f"{tmp_path}/in", rows)
    df = spark.createDataFrame(rows, stream.schema)
    for name, target, least, patience in (("target", 30, 1, 9), ("flat", 1000, 4, 2)):
        want = sorted(r.doc_id for r in instruct.until_target(df, "text", "round", "doc_id", target, least, patience).collect())
        run = lambda **more: rounds.run_rounds(stream, f"{tmp_path}/{name}", "text", "round", "doc_id", target, least, patience, **more)  # noqa: E731, B023
        part = sorted(r.doc_id for r in run(batches=1).collect())
        assert 0 < len(part) <= len(want) and set(part) <= set(want)
        assert sorted(r.doc_id for r in run().collect()) == want


def test_when_rounds_end():
    assert rounds.finished([(0, 5), (1, 5)], 10, 1, 3) == 1
    assert rounds.finished([(0, 0), (1, 5), (2, 0), (3, 0)], 100, 1, 2) == 3
    assert rounds.finished([(0, 5)], 100, 1, 2) is None and rounds.finished([], 1, 1, 1) is None


def test_tasks_grow_with_bytes_not_with_ranges(spark, tmp_path):
    parts = [(name, n, size) for name, n, size in (("a", 5000, 100), ("b", 1, 7), ("c", 3, ranges.TASK), ("d", 0, 5), ("e", 40, 1 << 20))]
    tasks = ranges.dealt(parts, 4)
    assert {(what, k) for t in tasks for what, a, b in t.runs for k in range(a, b)} == {(what, k) for what, n, _ in parts for k in range(n)}
    assert sum(b - a for t in tasks for _, a, b in t.runs) == 5044 and len(tasks) <= 7
    (tmp_path / "t.txt").write_bytes(b"some words " * 2000)
    assert ranges.text_ranges(spark, str(tmp_path), step=50).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.cut for r in ranges.cut_points(spark, str(tmp_path), 50).collect()) == plain_cuts(b"some words " * 2000, 50, 1 << 20)


def plain_cut(data, at, scan):
    """One cut by the plain search."""
    white = (i for i in range(at, min(len(data), at + scan)) if data[i : i + 1] in (b" ", b"\n", b"\r", b"\t") and not data[:i].decode("utf-8", "ignore")[-1:].isspace())
    return next(white, next(i for i in range(at, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80))


class Counted(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        found = super().read(n)
        self.bytes_read += len(found)
        return found


def test_cuts_read_about_the_bytes_that_they_need():
    """Not 64 KB a cut; where white space is far, the same place is found in several pieces."""
    data = b"some words of a text\n" * 10_000
    file = Counted(data)
    cuts = [ranges.cut_after(file, len(data), at, 1 << 20) for at in range(0, len(data), 1000)]
    assert sorted({*cuts, len(data)}) == plain_cuts(data, 1000, 1 << 20)
    assert file.bytes_read <= len(data) / 2
    for gap in (250, 255, 256, 257, 1279, 1280, 1281, 1284, 30_000, 150_000):  # about the ends of pieces, and beyond them
        for space in (b" ", "\u2003 x".encode(), "\u00a0\n y".encode()):
            data = b"a" * gap + space + "é".encode() * 300
            for scan in (gap + 1, gap + 4, 1 << 20, 200):
                assert ranges.cut_after(Counted(data), len(data), 1, scan) == plain_cut(data, 1, scan)
