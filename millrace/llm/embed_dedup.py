"""Embedding near-duplicates by Euclidean p-stable hashing.

A normalised vector's projection on a Gaussian direction, shifted and cut into cells of width ``WIDTH``, is one
hash; ``PER_TABLE`` of them make a bucket key, in each of ``TABLES`` tables. Vectors that share a bucket are
compared by exact cosine in double precision. At cosine 0.95 (distance 0.32) a hash agrees with probability
0.874 and a pair shares a bucket with probability 0.94, at 0.97 with 0.996; unrelated vectors share a given
bucket with probability 5e-7.

A pair is counted in the first table whose bucket it shares, so links are counted without listing them, and a
bucket returns a spanning forest in place of its pairs. Equal vectors collapse to one row with a count.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and
is kept; vectors of different length never link; repeated rows count as vectors of their own; a row with a null id
links like any other but names no component, so a component of null ids alone is null and kept; ids may be
strings; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, crowded, cut, per_group, prepare, spanning

WIDTH, PER_TABLE, TABLES, SEED = 2.0, 20, 40, 20
BLOCK = 1024
#: Rows of a group that are compared with all others at a time.
ROWS = 256


class Projections:
    """The hash functions for vectors of one length; the same on every machine for one seed."""

    def __init__(self, dim: int, tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, tables, per_table])
        self.directions = rng.standard_normal((dim, tables * per_table))
        self.shifts = rng.uniform(0, width, tables * per_table)
        self.mix = rng.integers(1, 1 << 62, per_table, dtype=np.int64) | 1
        self.shape, self.width, self.dim = (tables, per_table), width, dim

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) bucket numbers of 32 bits."""
        cells = np.floor((unit @ self.directions + self.shifts) / self.width).astype(np.int64).reshape(len(unit), *self.shape)
        with np.errstate(over="ignore"):
            mixed = (cells * self.mix + self.dim).sum(axis=2).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def links(vectors: DataFrame, cosine: float = 0.95, tables: int = TABLES, per_table: int = PER_TABLE, block: int = BLOCK) -> DataFrame:
    """(a, b, n): spanning links (n null) and, where b is null, n vectors linked with a, counted by weight.

    ``vectors`` is (id, v array<double>, weight), one row for each different vector.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions: dict[int, Projections] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby(frame["v"].map(len)):
                hashes = functions.setdefault(dim, Projections(dim, tables, per_table))
                own = hashes.keys(unit(np.stack(part["v"].to_numpy()).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(part["id"].to_numpy()), pa.array(list(own), pa.list_(pa.int32()))], ["id", "own"])

    def work(group: pd.DataFrame) -> pa.RecordBatch | None:
        n = len(group)
        if n < 2:
            return None
        group = group.sort_values("id")  # links lead to the smallest id, so that many buckets find the same ones
        table, (a, b) = int(group["key"].iloc[0]) >> 32, (int(group["_a"].iloc[0]), int(group["_b"].iloc[0]))
        u = unit(np.stack(group["v"].to_numpy()).astype(np.float64))
        near = np.zeros((n, n), dtype=bool)
        own, side, weight = np.stack(group["own"].to_numpy()), group["_own"].to_numpy(), group["weight"].to_numpy()
        count = np.zeros(n, dtype=np.int64)
        for at in range(0, n, ROWS):  # blocks of rows bound the memory of the products and of the pairs
            near[at : at + ROWS] = u[at : at + ROWS] @ u.T >= cosine
            first, second = np.nonzero(near[at : at + ROWS])
            first += at
            fresh = (first != second) & ((a == b) | (side[first] != side[second]))
            first, second = first[fresh], second[fresh]
            fresh = np.ones(len(first), dtype=bool)
            for earlier in range(table):
                fresh &= own[first, earlier] != own[second, earlier]
            count += np.bincount(first[fresh], weights=weight[second[fresh]], minlength=n).astype(np.int64)
        np.fill_diagonal(near, False)
        ids = group["id"].to_numpy()
        edges = spanning(n, lambda i, left: near[i, left])
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[[i for i, _ in edges]] if edges else ids[:0], ids[some]]), pa.int64()), pa.array([*(int(ids[j]) for _, j in edges), *[None] * len(some)], pa.int64()), pa.array([*[None] * len(edges), *count[some].tolist()], pa.int64())],
            ["a", "b", "n"],
        )

    told = cut(vectors.select("id", "v").mapInArrow(hashed, "id long, own array<int>"))
    keyed = told.select("id", F.posexplode("own").alias("t", "h"))
    keyed = keyed.select("id", F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    joined = crowded(keyed, "key", "id", block).join(vectors.join(told, "id"), "id")
    joined = joined.select("key", F.size("v").alias("_dim"), "_a", "_b", "_own", "id", "v", "weight", "own")
    return per_group(joined, ["key", "_dim", "_a", "_b"], work, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("raw"))
    v = F.transform("raw", lambda x: x.cast("double"))
    fit = F.coalesce(F.size("raw") > 0, F.lit(False)) & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("raw", lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    classes = rows.where(fit).groupBy("raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    found = cut(links(classes.select("id", v.alias("v"), "weight"), cosine))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    told = classes.join(roots, classes["id"] == roots["node"], "left").join(counts, classes["id"] == counts["a"], "left")
    told = cut(told.select("raw", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("part")))
    least = told.groupBy(F.col("part").alias("root")).agg(F.min("least").alias("component_id"))
    told = told.join(least, F.col("part") == F.col("root")).select("raw", "n_links", "component_id")
    out = rows.where(fit).join(told, "raw").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
