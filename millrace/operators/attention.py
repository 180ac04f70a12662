"""Causal attention over contexts of any length, block by block.

Positions are cut into stretches, and each stretch of queries meets each stretch of keys and values up to its own. A task holds
one stretch of queries and one batch of keys at a time, works on tiles of these and keeps, for each query and head, the largest score
so far, the sum of the weights relative to it and the weighted sum of values. Such a triple describes any set of keys, and two of them
merge in any order, so the stretches of a query meet in a small aggregation and no context is one task's work.

A long context has ``STRETCHES`` stretches, so a row is sent some ``STRETCHES`` times whatever the length; only the scores, which no
table holds, grow with its square. Beyond ``LONGEST`` positions a stretch grows no more, which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a block, and blocks of a stretch at least.
BLOCK, SEGMENT = 256, 64
#: Stretches of the longest context, their longest length, queries and keys of a tile, and contexts whose ends are broadcast.
STRETCHES, LONGEST, TILE, CONTEXTS = 16, 1 << 16, 256, 100_000


def rotated(x: np.ndarray, position: np.ndarray, theta: float) -> np.ndarray:
    """(n, heads, d) with interleaved pairs turned by position / theta ** (2 i / d)."""
    d = x.shape[2]
    angle = position[:, None, None] / theta ** (np.arange(0, d, 2) / d)
    out, even, odd = np.empty_like(x), x[:, :, 0::2], x[:, :, 1::2]
    out[:, :, 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[:, :, 1::2] = odd * np.cos(angle) + even * np.sin(angle)
    return out


class Partial:
    """Largest score, sum of weights and weighted values of each query and head, over the keys seen so far."""

    def __init__(self, q: np.ndarray, position: np.ndarray):
        n, heads, d = q.shape
        self.q, self.position = np.ascontiguousarray(q.transpose(1, 0, 2)) / np.sqrt(d), position
        self.most, self.weight, self.out = np.full((heads, n), -np.inf), np.zeros((heads, n)), np.zeros((heads, n, d))

    def add(self, k: np.ndarray, v: np.ndarray, position: np.ndarray) -> None:
        """Keys and values of rising positions."""
        turned, v = np.ascontiguousarray(k.transpose(1, 2, 0)), np.ascontiguousarray(v.transpose(1, 0, 2))
        for b in range(0, len(position), TILE):
            keys = position[b : b + TILE]
            for a in range(int(np.searchsorted(self.position, keys[0])) // TILE * TILE, len(self.position), TILE):
                self._tile(slice(a, a + TILE), turned[:, :, b : b + TILE], v[:, b : b + TILE], keys)

    def _tile(self, rows: slice, k: np.ndarray, v: np.ndarray, position: np.ndarray) -> None:
        own, scores = self.position[rows], self.q[:, rows] @ k
        if position[-1] > own[0]:
            scores = np.where(position[None, None, :] <= own[None, :, None], scores, -np.inf)
        most = np.maximum(self.most[:, rows], scores.max(axis=2))
        base = np.where(np.isinf(most), 0, most)
        kept, weights = np.exp(self.most[:, rows] - base), np.exp(scores - base[:, :, None])
        self.weight[:, rows] = self.weight[:, rows] * kept + weights.sum(axis=2)
        self.out[:, rows] = self.out[:, rows] * kept[:, :, None] + weights @ v
        self.most[:, rows] = most


def stretch(last: int, block: int = BLOCK, segment: int = SEGMENT) -> int:
    """Positions of a stretch where the longest context ends at ``last``: whole blocks, ``segment`` of them at least."""
    share = -(-(last + 1) // STRETCHES)
    return max(block * segment, -(-min(share, LONGEST) // block) * block)


def causal(rows: DataFrame, heads: int = 1, theta: float | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(context, position, out) of (context, position, q, k, v): each position attends to those up to its own.

    The vectors are cut into ``heads`` parts of an even size; with ``theta`` queries and keys are turned by their position first.
    Positions are whole numbers from 0 on; the ends of the contexts are read first.
    """
    names, parts = ["context", "own", "part"], ["context", "position", "most", "weight", "out"]

    def vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
        lists = batch.column(name)
        return lists.flatten().to_numpy().reshape(len(lists), heads, -1)

    def turned(x: np.ndarray, position: np.ndarray) -> np.ndarray:
        return x if theta is None else rotated(x, position, theta)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            if state is None:
                return
            some = np.flatnonzero(state.weight.max(axis=0) > 0)
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (x[some].size // max(len(some), 1)), pa.int32()), pa.array(x[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key[0])), pa.array(state.position[some]), flat(state.most.T), flat(state.weight.T), flat(state.out.transpose(1, 0, 2))], parts)

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*names, "kind")]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                if a == b:
                    continue
                now, piece = tuple(int(c[a]) for c in columns[:3]), batch.slice(a, b - a)
                if now != key:
                    yield from told()
                    key, held, state = now, [], None
                position = piece.column("position").to_numpy()
                if not columns[3][a]:
                    held.append((turned(vectors(piece, "q"), position), position))
                    continue
                if state is None:
                    state = Partial(*(np.concatenate(x) for x in zip(*held, strict=True)))
                state.add(turned(vectors(piece, "k"), position), vectors(piece, "v"), position)
        yield from told()

    asking = rows.groupBy("context").agg(F.max("position").alias("last"))
    contexts, last = asking.agg(F.count(F.lit(1)), F.max("last")).first()
    length = stretch(last or 0, block, segment)
    own, none = F.floor(F.col("position") / length), F.lit(None).cast("array<double>")
    ends = asking.select("context", F.floor(F.col("last") / length).alias("last"))
    blocks = F.explode(F.sequence(own, F.col("last")))
    given = rows.join(F.broadcast(ends) if contexts <= CONTEXTS else ends, "context").select("context", blocks.alias("own"), own.alias("part"), F.lit(1).alias("kind"), "position", none.alias("q"), "k", "v")
    asked = rows.select("context", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("part"), F.lit(0).alias("kind"), "position", "q", none.alias("k"), none.alias("v"))
    dealt = given.union(asked).repartition(*names).sortWithinPartitions(*names, "kind", "position")
    partial = dealt.mapInArrow(each, "context long, position long, most array<double>, weight array<double>, out array<double>")
    return merged(partial, heads)


def merged(partial: DataFrame, heads: int) -> DataFrame:
    """(context, position, out) from the partial results of each position, one for each stretch of keys."""
    gathered = partial.groupBy("context", "position").agg(F.collect_list(F.struct("most", "weight", "out")).alias("p"))

    def of_head(h: int):
        top = F.array_max(F.transform("p", lambda p: F.get(p["most"], F.lit(h))))
        share = lambda p, most: F.exp(F.get(p["most"], F.lit(h)) - most)
        total = lambda most: F.aggregate("p", F.lit(0.0), lambda s, p: s + share(p, most) * F.get(p["weight"], F.lit(h)))
        size = (F.size(F.get("p", F.lit(0))["out"]) / heads).cast("int")
        sums = lambda most: F.aggregate("p", F.array_repeat(F.lit(0.0), size), lambda s, p: F.zip_with(s, F.slice(p["out"], F.lit(h) * size + 1, size), lambda x, y: x + share(p, most) * y))
        return F.get(F.transform(F.array(top), lambda most: F.get(F.transform(F.array(total(most)), lambda whole: F.transform(sums(most), lambda x: x / whole)), F.lit(0))), F.lit(0))

    return gathered.select("context", "position", F.concat(*[of_head(h) for h in range(heads)]).alias("out"))
