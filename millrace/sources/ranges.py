"""Text files in byte ranges that end before white space, as a Python data source.

Range k of a file runs from the cut at or after byte k * step to that after (k + 1) * step. A cut stands before the first
white space whose predecessor is none, so a run of white space and the word behind it stay together and pre-tokens of the ranges
are those of the file. Where no such place comes within ``scan`` bytes or before the end, the cut is made at the byte itself, or after the
character that it falls into. Each task finds its own cuts, so planning reads no more than file sizes. Ranges that are small are
dealt in runs, so the tasks grow with the bytes and not with the ranges.

Files are opened with Arrow's file systems: local folders and the object stores that it knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP, SCAN = 32 << 20, 1 << 20
_SPACE = b" \n\r\t"
#: Bytes that the search for a cut reads first, and at most at a time: white space is near as a rule.
_FIRST, _PIECE = 1 << 8, 1 << 16
#: Bytes of a task where ranges are smaller, bytes that opening a file counts for, and bytes and rows of a batch.
TASK, OPENING = 32 << 20, 64 << 10
BATCH, ROWS = 1 << 20, 4096


@dataclass
class Dealt(InputPartition):
    """What one task reads: runs (what, first, last) of ranges, the last one not included."""

    runs: list[tuple[Any, int, int]]


def dealt(parts: Iterable[tuple[Any, int, int]], tasks: int) -> list[Dealt]:
    """Parts (what, ranges, bytes of a range) as tasks of equal bytes: ``tasks`` of them, or more if these held over ``TASK`` bytes."""
    parts = list(parts)
    total = sum(n * size + OPENING for _, n, size in parts)
    share = max(1, min(TASK, -(-total // max(1, tasks))))
    out, now, held = [], [], 0
    for what, n, size in parts:
        at, held = 0, held + OPENING
        while at < n:
            to = min(n, at + max(1, -(-(share - held) // max(1, size))))
            now.append((what, at, to))
            at, held = to, held + (to - at) * size
            if held >= share:
                out.append(Dealt(now))
                now, held = [], 0
    return [*out, Dealt(now)] if now else out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of one file, sorted; names that begin with _ or . are left out."""
    store, inner = opened(path)
    root = path[: len(path) - len(inner)]
    infos = [store.get_file_info(inner)]
    if infos[0].type == fs.FileType.Directory:
        infos = store.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda i: any(part[:1] in ("_", ".") for part in i.path[len(inner) :].split("/"))
    return sorted((root + i.path, i.size) for i in infos if i.type == fs.FileType.File and not hidden(i) and i.path.endswith(suffix))


def cut_after(file: pa.NativeFile, size: int, at: int, scan: int) -> int:
    """The first place at or after byte ``at`` where white space follows something else."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    file.seek(max(0, at - 4))
    before = file.read(at - max(0, at - 4))
    after_space = before.decode("utf-8", "ignore")[-1:].isspace()
    offset, many = 0, _FIRST
    while offset < scan:
        piece = file.read(min(many, scan - offset))
        if not piece:
            break
        for i, byte in enumerate(piece):
            if byte in _SPACE:
                if not after_space:
                    return at + offset + i
                continue
            if byte >= 0x80:  # a wider white space may end here
                seen = (before + piece[max(0, i - 3) : i + 1])[-4:] if i < 3 else piece[i - 3 : i + 1]
                after_space = seen.decode("utf-8", "ignore")[-1:].isspace()
            else:
                after_space = chr(byte).isspace()
        before = piece[-4:]
        offset, many = offset + len(piece), min(_PIECE, 4 * many)
    file.seek(at)
    inside = file.read(4)
    return at + next((i for i, b in enumerate(inside) if b & 0xC0 != 0x80), len(inside))


class RangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step, self.scan = options["path"], int(options.get("step", STEP)), int(options.get("scan", SCAN))
        self.texts, self.tasks = options.get("texts", "true") == "true", int(options.get("tasks", 1))

    def partitions(self) -> list[Dealt]:
        return dealt((((path, size), -(-size // self.step), min(self.step, size)) for path, size in files_below(self.path)), self.tasks)

    def read(self, part: Dealt) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for (path, size), first, last in part.runs:
            store, inner = opened(path)
            with store.open_input_file(inner) as file:
                start = cut_after(file, size, first * self.step, self.scan)
                for number in range(first + 1, last + 1):
                    end = cut_after(file, size, number * self.step, self.scan)
                    if start < end:
                        text = None
                        if self.texts:
                            file.seek(start)
                            text = file.read(end - start).decode("utf-8", "ignore")
                            held += end - start
                        rows.append((path, start, end, text))
                    start = end
                    if held >= BATCH or len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "start": pa.int64(), "end": pa.int64(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


class TextRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return "path string, start long, end long, text string"

    def reader(self, schema) -> RangesReader:
        return RangesReader(self.options)


def text_ranges(spark: SparkSession, path: str, step: int = STEP, scan: int = SCAN, texts: bool = True) -> DataFrame:
    """(path, start, end, text) of the ranges of all files below ``path``; without ``texts`` only the ranges."""
    spark.dataSource.register(TextRanges)
    return spark.read.format("text_ranges").options(step=step, scan=scan, texts=str(texts).lower(), tasks=spark.sparkContext.defaultParallelism).load(path)


def cut_points(spark: SparkSession, path: str, step: int = STEP, scan: int = SCAN) -> DataFrame:
    """(path, cut): the distinct places where the files begin, are cut and end."""
    ranges = text_ranges(spark, path, step, scan, texts=False)
    return ranges.select("path", F.explode(F.array("start", "end")).alias("cut")).distinct()
