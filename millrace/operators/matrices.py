"""Matrices in long form (module, i, j, v) or in tiles (module, bi, bj, v), for weights that are too many for one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import adamw, clip_factor


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(module, i, j, v) of a times b; an entry that is missing is zero."""
    left = a.select("module", "i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = b.select("module", F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return left.join(right, ["module", "k"]).groupBy("module", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def norm(m: DataFrame, name: str) -> DataFrame:
    return m.groupBy("module").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(name))


def update(w: DataFrame, a: DataFrame, b: DataFrame, scale: float, gated: bool) -> DataFrame:
    """The adapter's change to w: scale * a b, or with ``gated`` scale * w o (a b)."""
    ab = product(a, b)
    if not gated:
        return ab.withColumn("v", F.col("v") * scale)
    return w.join(ab.withColumnRenamed("v", "ab"), ["module", "i", "j"]).select("module", "i", "j", (F.col("v") * F.col("ab") * scale).alias("v"))


def fold(w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """Dense weights w + scale * w o (a b)."""
    ab = product(a, b).withColumnRenamed("v", "ab")
    return w.join(ab, ["module", "i", "j"], "left").select("module", "i", "j", (F.col("v") * (1 + scale * F.coalesce("ab", F.lit(0.0)))).alias("v"))


def adapter_summary(w: DataFrame, a: DataFrame, b: DataFrame, scale: float, gated: bool = True) -> DataFrame:
    """(norm_a, norm_b, ratio): means over modules; the ratio is the change's norm to that of w, 0 where w is zero."""
    change = norm(update(w, a, b, scale, gated), "change")
    both = norm(a, "norm_a").join(norm(b, "norm_b"), "module").join(change, "module").join(norm(w, "norm_w"), "module")
    ratio = F.when(F.col("norm_w") > 0, F.col("change") / F.col("norm_w")).otherwise(F.lit(0.0))
    return both.agg(F.avg("norm_a").alias("norm_a"), F.avg("norm_b").alias("norm_b"), F.avg(ratio).alias("ratio"))


#: Rows and columns of a tile.
TILE = 256


def tiles(m: DataFrame, size: int = TILE) -> DataFrame:
    """(module, bi, bj, v) of long-form ``m``: dense tiles of ``size`` x ``size``, row by row; what is missing is zero."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            ends = batch.column(3).value_lengths().to_numpy()
            out = np.zeros((batch.num_rows, size * size))
            out[np.repeat(np.arange(len(ends)), ends), at] = v
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["module", "bi", "bj", "v"])

    at = (F.col("i") % size * size + F.col("j") % size).cast("int")
    placed = m.select("module", F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), F.struct(at.alias("at"), F.col("v").cast("double").alias("v")).alias("e"))
    held = placed.groupBy("module", "bi", "bj").agg(F.collect_list("e").alias("e"))  # at most size * size entries
    return held.select("module", "bi", "bj", F.transform("e", lambda e: e["at"]).alias("at"), F.transform("e", lambda e: e["v"]).alias("v")).mapInArrow(filled, "module long, bi long, bj long, v array<double>")


def untiled(t: DataFrame, size: int = TILE) -> DataFrame:
    """(module, i, j, v) of all entries of the tiles that are there, zeros too."""
    each = t.select("module", "bi", "bj", F.posexplode("v").alias("at", "v"))
    return each.select("module", (F.col("bi") * size + F.floor(F.col("at") / size)).alias("i"), (F.col("bj") * size + F.col("at") % size).alias("j"), "v")


def tile_product(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of a times b.

    Tiles meet by the block that they share; each pair is one product of matrices in a task. A task adds up the products of a tile
    as they pass in order, so it holds two tiles, and what is shuffled is a tile for each product, ``size`` times less than
    the products of entries.
    """
    left = a.select("module", "bi", F.col("bj").alias("bk"), F.col("v").alias("a"))
    right = b.select("module", F.col("bi").alias("bk"), "bj", F.col("v").alias("b"))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().reshape(-1, size, size) for k in (3, 4))
            yield told([batch.column(k) for k in range(3)], x @ y)

    def told(keys: list[pa.Array], v: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * size * size, pa.int32()), pa.array(v.ravel()))
        return pa.RecordBatch.from_arrays([*keys, lists], ["module", "bi", "bj", "v"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key, v = tuple(batch.column(c)[k].as_py() for c in range(3)), batch.column(3)[k].values.to_numpy()
                if key != now:
                    if now is not None:
                        yield told([pa.array([x], pa.int64()) for x in now], total[None])
                    now, total = key, np.zeros(size * size)
                total += v
        if now is not None:
            yield told([pa.array([x], pa.int64()) for x in now], total[None])

    schema, keys = "module long, bi long, bj long, v array<double>", ["module", "bi", "bj"]
    products = left.join(right, ["module", "bk"]).select(*keys, "a", "b").mapInArrow(multiplied, schema)
    return products.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed, schema)


def _changed(w: DataFrame, a: DataFrame, b: DataFrame, scale: float, gated: bool, size: int) -> DataFrame:
    """(module, bi, bj, w, u): tiles of w with those of the adapter's change, zero where a b has none; one product for both."""
    ab = tile_product(a, b, size).withColumnRenamed("v", "ab")
    both = w.withColumnRenamed("v", "w").join(ab, ["module", "bi", "bj"], "left")
    change = F.zip_with("w", "ab", lambda x, y: x * y * scale) if gated else F.transform("ab", lambda y: y * scale)
    return both.select("module", "bi", "bj", "w", F.coalesce(change, F.transform("w", lambda x: F.lit(0.0))).alias("u"))


def fold_tiles(w: DataFrame, a: DataFrame, b: DataFrame, scale: float, gated: bool = True, size: int = TILE) -> DataFrame:
    """Tiles of w + scale * w o (a b), or without ``gated`` of w + scale * a b."""
    return _changed(w, a, b, scale, gated, size).select("module", "bi", "bj", F.zip_with("w", "u", lambda x, y: x + y).alias("v"))


def adapter_summary_tiles(w: DataFrame, a: DataFrame, b: DataFrame, scale: float, gated: bool = True, size: int = TILE) -> DataFrame:
    """As ``adapter_summary``, from tiles."""
    squares = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    own = lambda m, name: m.groupBy("module").agg(F.sqrt(squares("v")).alias(name))
    sizes = _changed(w, a, b, scale, gated, size).groupBy("module").agg(F.sqrt(squares("u")).alias("change"), F.sqrt(squares("w")).alias("norm_w"))
    ratio = F.when(F.col("norm_w") > 0, F.col("change") / F.col("norm_w")).otherwise(F.lit(0.0))
    both = own(a, "norm_a").join(own(b, "norm_b"), "module").join(sizes, "module")
    return both.agg(F.avg("norm_a").alias("norm_a"), F.avg("norm_b").alias("norm_b"), F.avg(ratio).alias("ratio"))


def gather(ids: DataFrame, table: DataFrame, token: str = "token", vector: str = "vector") -> DataFrame:
    """``ids`` (row, position, ``token``) with the vector of each token from ``table`` (``token``, ``vector``), a missing one null.

    Spark broadcasts the table if it knows it to be small enough and else shuffles both sides by token.
    """
    return ids.join(table.select(token, vector), token, "left")


def clipped(vectors: DataFrame, most: float, eps: float = 1e-6) -> DataFrame:
    """(norm, factor) over all ``vectors`` (v array<double>) taken as one: the global norm and what scales it to ``most``."""
    norm_of = F.sqrt(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return vectors.agg(F.coalesce(norm_of, F.lit(0.0)).alias("norm")).withColumn("factor", clip_factor(F.col("norm"), most, eps))


def causal_attention(rows: DataFrame) -> DataFrame:
    """(context, position, out) of (context, position, q, k, v), arrays of double; a context is one task's group."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        q, k, v = (np.stack(frame[n].to_numpy()) for n in ("q", "k", "v"))
        scores = q @ k.T / np.sqrt(q.shape[1])
        scores[np.triu_indices(len(frame), 1)] = -np.inf
        weights = np.exp(scores - scores.max(axis=1, keepdims=True))
        out = weights / weights.sum(axis=1, keepdims=True) @ v
        return pd.DataFrame({"context": frame["context"], "position": frame["position"], "out": list(out)})

    return rows.groupBy("context").applyInPandas(each, "context long, position long, out array<double>")


def parameters(blocks: DataFrame) -> DataFrame:
    """(name, start, w, m, v, t) of blocks (name, start, values): weights with zero moments, before any step."""
    zeros = F.transform("values", lambda x: F.lit(0.0))
    return blocks.select("name", "start", F.col("values").alias("w"), zeros.alias("m"), zeros.alias("v"), F.lit(0).alias("t"))


def optimizer_step(params: DataFrame, gradients: DataFrame, rate: float = 1e-3, decay: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """``params`` after one AdamW step with ``gradients`` (name, start, g); a block without a gradient stays as it is.

    Blocks meet their gradients in one join; both tables may be written bucketed by name and start, and then nothing is shuffled.
    """
    both = params.join(gradients.select("name", "start", "g"), ["name", "start"], "left")
    now = F.when(F.col("g").isNull(), F.struct("w", "m", "v")).otherwise(adamw(F.col("w"), F.col("g"), F.col("m"), F.col("v"), F.col("t") + 1, rate, decay, betas, eps))
    return both.select("name", "start", now.alias("s"), (F.col("t") + F.col("g").isNotNull().cast("int")).alias("t")).select("name", "start", "s.w", "s.m", "s.v", "t")
