"""Tensor files as tables: a Python data source that reads values by offset, block by block, and writes from the executors.

A file is an eight-byte length, a JSON header with each tensor's type, shape and byte offsets, and the values (the safetensors
layout). Planning reads headers only; a partition is a run of blocks, read some at a time, so no file and no large tensor is loaded whole. What needs
names and shapes alone, such as counts of parameters, reads no value.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from millrace.sources.ranges import ROWS, Dealt, dealt, files_below, opened

#: Values of a block.
BLOCK = 1 << 20
# The layout's names of number types.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "|u1"}


@dataclass
class Tensor:
    path: str
    name: str
    kind: str
    shape: tuple[int, ...]
    begin: int
    n: int


def read_header(file: pa.NativeFile) -> tuple[dict, int]:
    """(entries by name, where the values begin)."""
    size = int.from_bytes(file.read(8), "little")
    entries = json.loads(file.read(size))
    entries.pop("__metadata__", None)
    return entries, 8 + size


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.values = options["path"], int(options.get("block", BLOCK)), options.get("values", "true") == "true"
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Dealt]:
        out = []
        for path, _ in files_below(self.path, ".safetensors"):
            store, inner = opened(path)
            with store.open_input_file(inner) as file:
                entries, begin = read_header(file)
            for name, e in entries.items():
                tensor = Tensor(path, name, e["dtype"], tuple(e["shape"]), begin + e["data_offsets"][0], math.prod(e["shape"]))
                out.append((tensor, max(1, -(-tensor.n // self.block)), min(self.block, tensor.n) * np.dtype(KINDS[tensor.kind]).itemsize) if self.values else (tensor, 1, 0))
        return dealt(out, self.tasks) or [Dealt([])]

    def read(self, part: Dealt) -> Iterator[pa.RecordBatch]:
        some = max(1, min(ROWS, BLOCK // self.block))
        for tensor, first, last in part.runs:
            if not self.values:
                yield self._rows(tensor, [0], pa.nulls(1, pa.list_(pa.float64())))
                continue
            store, inner = opened(tensor.path)
            kind = np.dtype(KINDS[tensor.kind])
            with store.open_input_file(inner) as file:
                file.seek(tensor.begin + first * self.block * kind.itemsize)
                for k in range(first, last, some):
                    bounds = np.minimum(np.arange(k, min(k + some, last) + 1) * self.block, tensor.n)
                    values = np.frombuffer(file.read(int(bounds[-1] - bounds[0]) * kind.itemsize), dtype=kind).astype(np.float64)
                    yield self._rows(tensor, bounds[:-1], pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(values)))

    @staticmethod
    def _rows(tensor: Tensor, starts, values: pa.Array) -> pa.RecordBatch:
        same = lambda x, kind: pa.array([x] * len(values), kind)
        return pa.RecordBatch.from_arrays(
            [same(tensor.path, pa.string()), same(tensor.name, pa.string()), same(tensor.kind, pa.string()), same(list(tensor.shape), pa.list_(pa.int64())), pa.array(starts, pa.int64()), values],
            ["path", "name", "kind", "shape", "start", "values"],
        )


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = opened(self.path)
        now, out, names = None, None, []
        for batch in iterator:
            files, headers, values = (batch.column(c) for c in ("file", "header", "values"))
            for k, file in enumerate(files.to_pylist()):
                if file != now:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{inner}/_writing")
                    names.append((f"{inner}/_writing/{uuid.uuid4().hex}", f"{inner}/{file}.safetensors"))
                    out, now, head = store.open_output_stream(names[-1][0]), file, headers[k].as_py().encode()
                    out.write(len(head).to_bytes(8, "little") + head)
                out.write(values[k].values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = opened(self.path)
        store.create_dir(inner)
        for written, name in (pair for m in messages if m for pair in m.names):
            store.move(written, name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = opened(self.path)
        if store.get_file_info(f"{inner}/_writing").type.name == "Directory":
            store.delete_dir(f"{inner}/_writing")


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "path string, name string, kind string, shape array<long>, start long, values array<double>"

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options)


def read_tensors(spark: SparkSession, path: str, block: int = BLOCK, values: bool = True) -> DataFrame:
    """(path, name, kind, shape, start, values): a row for each ``block`` values of a tensor; without ``values`` one row a tensor."""
    spark.dataSource.register(Tensors)
    return spark.read.format("tensors").options(block=block, values=str(values).lower(), tasks=spark.sparkContext.defaultParallelism).load(path)


def write_tensors(blocks: DataFrame, path: str) -> None:
    """Blocks (file, name, shape, start, values) as files of 32-bit numbers <file>.safetensors at ``path``.

    Names and shapes give the headers; the blocks of a file then meet in one task in order and pass through it to the file.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(Tensors)
    named = blocks.select("file", "name", "shape").distinct().groupBy("file").agg(F.sort_array(F.collect_list(F.struct("name", "shape"))).alias("t"))
    size = lambda shape: F.aggregate(shape, F.lit(4).cast("long"), lambda n, d: n * d)
    kind = "struct<at:bigint,entries:array<string>>"
    quoted = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"^\[(.*)\]$", 1)

    def step(s: Column, t: Column) -> Column:
        until = s["at"] + size(t["shape"])
        entry = F.concat(quoted(t["name"]), F.lit(':{"dtype":"F32","shape":'), F.to_json(t["shape"]), F.lit(',"data_offsets":['), s["at"].cast("string"), F.lit(","), until.cast("string"), F.lit("]}"))
        return F.struct(until.alias("at"), F.concat(s["entries"], F.array(entry)).alias("entries")).cast(kind)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("entries")).cast(kind)
    headers = named.select("file", F.concat(F.lit("{"), F.array_join(F.aggregate("t", start, step, lambda s: s["entries"]), ","), F.lit("}")).alias("header"))
    placed = blocks.join(headers, "file").repartition("file").sortWithinPartitions("file", "name", "start")
    placed.select("file", "header", "values").write.format("tensors").mode("append").save(path)


def elements(shape: Column | str) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, d: n * d)


def is_adapter(name: Column, anywhere: bool = False) -> Column:
    """Whether a parameter is one of an adapter's two matrices: ``.A`` or ``.B`` in its name, or just the letter with ``anywhere``."""
    return F.contains(name, F.lit("A" if anywhere else ".A")) | F.contains(name, F.lit("B" if anywhere else ".B"))


def parameter_counts(tensors: DataFrame, trainable: Column) -> DataFrame:
    """(total, trainable, percent) over tensors, one row each; 0 percent where there are none."""
    n = elements("shape")
    sums = tensors.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(trainable, n)), F.lit(0)).alias("trainable"))
    return sums.withColumn("percent", F.when(F.col("total") > 0, 100 * F.col("trainable") / F.col("total")).otherwise(F.lit(0.0)))


def of_module(tensors: DataFrame, module: str) -> DataFrame:
    """The tensors of one module with bare names, from any of three layouts of a file: names that begin with <module>., with
    model.<module>., or bare ones, the first that occurs in the file."""
    own, inner = f"{module}.", f"model.{module}."
    layout = F.when(F.startswith("name", F.lit(own)), 0).when(F.startswith("name", F.lit(inner)), 1).otherwise(2)
    marked = tensors.withColumn("_layout", layout)
    first = marked.groupBy("path").agg(F.min("_layout").alias("_layout"))
    bare = F.when(F.col("_layout") == 0, F.substr("name", F.lit(len(own) + 1))).when(F.col("_layout") == 1, F.substr("name", F.lit(len(inner) + 1))).otherwise(F.col("name"))
    return marked.join(first, ["path", "_layout"]).withColumn("name", bare).drop("_layout")
