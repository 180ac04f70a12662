"""Token shards as one-dimensional array files (.npy), a Python data source that writes and reads on the executors.

Writing: the rows of a shard meet in one task in order, each with the shard's number of tokens, so the task writes the file's
header first and then passes the tokens on as they come. Files are written under other names; when all tasks have ended, the
driver renames them, and a job that fails leaves none. Reading: planning reads the files' headers, and a partition is a run of
ranges of tokens, of one file or of several small ones.

Files are opened with Arrow's file systems: local folders and the object stores that it knows.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from millrace.sources.ranges import BATCH, ROWS, Dealt, dealt, files_below, opened

#: Tokens of a partition and of a row when reading.
RANGE, ROW = 16 << 20, 1 << 16
NAME = r"-([a-z]+)-[^-/]*-shard(\d+)\.npy$"


def header(kind: str, n: int) -> bytes:
    out = io.BytesIO()
    npy.write_array_header_1_0(out, {"descr": npy.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": (n,)})
    return out.getvalue()


def read_header(file: pa.NativeFile) -> tuple[int, np.dtype, int]:
    """(tokens, their type, where they begin) of an array file."""
    version = npy.read_magic(file)
    shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
    if len(shape) != 1 or kind.hasobject:
        raise ValueError(f"not an array of tokens: shape {shape}, type {kind}")
    return shape[0], kind, file.tell()


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.prefix = options["path"], options["kind"], options.get("prefix", "tokens")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = opened(self.path)
        now, out, names = None, None, []
        for batch in iterator:
            split, shard, total = (batch.column(c).to_pylist() for c in ("split", "shard_id", "total"))
            ids = batch.column("token_ids")
            for k, key in enumerate(zip(split, shard, strict=True)):
                if key != now:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{inner}/_writing")
                    names.append((f"{inner}/_writing/{uuid.uuid4().hex}", f"{inner}/{self.prefix}-{key[0]}-all-shard{key[1]}.npy"))
                    out, now = store.open_output_stream(names[-1][0]), key
                    out.write(header(self.kind, total[k]))
                out.write(ids[k].values.to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = opened(self.path)
        store.create_dir(inner)
        for written, name in (pair for m in messages if m for pair in m.names):
            store.move(written, name)
        self._clear(store, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    @staticmethod
    def _clear(store, inner: str) -> None:
        folder = f"{inner}/_writing"
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


@dataclass
class Shard:
    path: str
    kind: str
    begin: int
    n: int


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range, self.row = options["path"], int(options.get("range", RANGE)), int(options.get("row", ROW))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Dealt]:
        out = []
        for path, _ in files_below(self.path, ".npy"):
            store, inner = opened(path)
            with store.open_input_file(inner) as file:
                n, kind, begin = read_header(file)
            out.append((Shard(path, kind.str, begin, n), max(1, -(-n // self.range)), min(self.range, n) * kind.itemsize))
        if not out:
            raise FileNotFoundError(f"no token shards at {self.path}")
        return dealt(out, self.tasks)

    def read(self, part: Dealt) -> Iterator[pa.RecordBatch]:
        for shard, first, last in part.runs:
            store, inner = opened(shard.path)
            named, kind = re.search(NAME, shard.path), np.dtype(shard.kind)
            split, number = named and named[1], named and int(named[2])
            with store.open_input_file(inner) as file:
                file.seek(shard.begin + first * self.range * kind.itemsize)
                for starts, sizes in self._rows(shard.n, first, last):
                    bounds = np.cumsum([0, *sizes])
                    ids = np.frombuffer(file.read(int(bounds[-1]) * kind.itemsize), dtype=kind).astype(np.int32)
                    lists, n = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array([shard.path] * n), pa.array([split] * n, pa.string()), pa.array([number] * n, pa.int32()), pa.array(starts, pa.int64()), lists], ["path", "split", "shard_id", "start", "token_ids"])

    def _rows(self, n: int, first: int, last: int) -> Iterator[tuple[list[int], list[int]]]:
        """Where the rows of some ranges begin and how many tokens they hold, a batch at a time."""
        starts, sizes, held = [], [], 0
        for k in range(first, last):
            end = min((k + 1) * self.range, n)
            for a in range(k * self.range, max(end, k * self.range + 1), self.row):
                starts.append(a)
                sizes.append(min(self.row, end - a))
                held += sizes[-1]
                if held >= BATCH or len(starts) >= ROWS:
                    yield starts, sizes
                    starts, sizes, held = [], [], 0
        if starts:
            yield starts, sizes


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "path string, split string, shard_id int, start long, token_ids array<int>"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def write_npy(tokens: DataFrame, path: str, vocab_size: int, prefix: str = "tokens") -> None:
    """Tokens (split, shard_id, seq_no, token_ids) as files <prefix>-<split>-all-shard<k>.npy at ``path``, of 16 bits if the vocabulary
    allows. Ids are not split over tasks within a shard, so its size bounds a task's time, not its memory."""
    tokens.sparkSession.dataSource.register(TokenShards)
    keys = ["split", "shard_id"]
    sized = tokens.repartition(*keys).withColumn("total", F.sum(F.size("token_ids").cast("long")).over(Window.partitionBy(*keys)))  # one shuffle serves both
    placed = sized.sortWithinPartitions(*keys, "seq_no").select(*keys, "total", "token_ids")
    placed.write.format("token_shards").mode("append").options(kind="uint16" if vocab_size <= 65_535 else "uint32", prefix=prefix).save(path)


def read_npy(spark: SparkSession, path: str, length: int = RANGE, row: int = ROW) -> DataFrame:
    """(path, split, shard_id, start, token_ids) of files named <prefix>-<split>-<lines>-shard<k>.npy: rows of at most ``row`` tokens in
    ranges of ``length``, of which a task reads as many as make up its bytes; an error if there are no files."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").options(range=length, row=row, tasks=spark.sparkContext.defaultParallelism).load(path)
