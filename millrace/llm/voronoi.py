"""Exact top-k search by inner product as a kNN join over a Voronoi partition.

Scores become distances by one more coordinate (``integers.Lifted``). Every row belongs to the cell of its nearest pivot, as a
query to that of the nearest pivot lifted as queries are, and
two small summaries hold what bounds need: for each cell of queries their number and largest distance to the pivot, for each
cell of data its number of rows, smallest and largest distance and the distances of the k + 1 rows nearest to the pivot. From
these follows, for each cell of queries, a distance within which k other rows are sure to lie. Cells of queries that are near
each other form groups; a data row is replicated to the groups in which its distance to its pivot leaves it a chance, and each
group is solved on its own. In the local step rows come in order of a lower bound of their distance, and a query looks at no
row whose bound is beyond its own k-th score.

Scale: pivots are at most ``PIVOTS`` rows, drawn by a hash of the vector, and what goes to the driver and to every task is a
few numbers for each pair of a group and a cell. A group of many queries is split, and the data of a group are dealt to slices
by a number of the row, so neither a hot cell nor copies of one vector make a large task; a task streams its rows and holds the
queries of one split and one chunk. In many dimensions bounds rule out little and the join costs what comparing blocks costs.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0 with all;
vectors of different lengths, very large components: see ``integers``; repeated rows are rows of their own, each a query and a
candidate of the others; a null id is no query, ranks behind other ids at equal scores and comes out null; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, partitions, prepare
from millrace.llm.integers import Lifted, distances, matrix, norm2, products, usable, whole

#: Pivots at most, and bytes of them.
PIVOTS, PIVOT_BYTES = 512, 16 << 20
#: Queries of a split; rows of a slice, few and many; rows of a chunk.
QUERIES, SLICE, LONG_SLICE, CHUNK = 1024, 8192, 1 << 20, 2048

_KEY = ["part", "split", "slice"]


def groups_of(between: np.ndarray, sizes: dict[int, int], most: int) -> list[list[int]]:
    """Cells of queries in groups of about ``most`` queries, each grown from a cell by the nearest ones left."""
    left, out = sorted(sizes), []
    while left:
        own = [left.pop(0)]
        held = sizes[own[0]]
        for cell in sorted(left, key=lambda c: (between[own[0], c], c)):
            if held + sizes[cell] > most:
                break
            own.append(cell)
            held += sizes[cell]
        left = [c for c in left if c not in own]
        out.append(own)
    return out


class Best:
    """The k best rows of each query so far: by score, then smaller id (nulls last), then row."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.query = np.zeros(0, dtype=np.int64)
        self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.null = np.zeros(0, dtype=bool)
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        query, score, ids, null, row = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.null, null), (self.row, row)))
        order = np.lexsort((row, ids, null, ~score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.score, self.id, self.null, self.row = query[place < self.k], score[keep], ids[keep], null[keep], row[keep]
        full = np.flatnonzero(np.bincount(self.query, minlength=self.n) == self.k)
        self.least[full] = self.score[np.searchsorted(self.query, full, side="right") - 1]


def assigned(rows: DataFrame, pivots: list[np.ndarray], lifted: Lifted) -> DataFrame:
    """``rows`` (id, is_query, v) with the nearest of the ``pivots`` for data and for queries, its distance, and a number of the row."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = matrix(batch.column(2), lifted.dim), []
            for lift, centres in zip((lifted.data, lifted.query), shared.value, strict=True):
                far = distances(lift(v), centres)
                cell = far.argmin(axis=1)
                own += [pa.array(cell, pa.int32()), pa.array(far[np.arange(len(v)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["id", "is_query", "v", "cell", "d", "q_cell", "q_d"])

    schema = "id long, is_query boolean, v array<double>, cell int, d double, q_cell int, q_d double"
    return cut(rows.mapInArrow(each, schema).withColumn("row", F.monotonically_increasing_id()))


def plan(spots: DataFrame, pivots: list[np.ndarray], k: int, slack: float) -> tuple[list[tuple], list[tuple]]:
    """(part, cell, low, high, reach, splits, slices) for data and (cell, part, splits, slices) for queries, from the summaries."""
    between = distances(pivots[1], pivots[0])
    nearest = Window.partitionBy("cell").orderBy("d", "row")
    summary = spots.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
    close = spots.select("cell", "d", "row").withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= k + 1).select("cell", "d").collect()
    asking = {r.q_cell: r for r in spots.where("is_query").groupBy("q_cell").agg(F.count(F.lit(1)).alias("n"), F.max("q_d").alias("far")).collect()}
    cell, d = np.array([r.cell for r in close], dtype=np.int64), np.array([r.d for r in close])
    far = {i: r.far + slack for i, r in asking.items()}

    def sure(i: int) -> float:
        """A distance within which every query of cell i has k rows beside its own."""
        all_of = far[i] + between[i, cell] + d
        return float(np.partition(all_of, k)[k]) + slack if len(all_of) > k else math.inf

    reach = {i: sure(i) for i in asking}
    workers = partitions(spots.sparkSession)
    data, queries = [], []
    for part, own in enumerate(groups_of(distances(pivots[1], pivots[1]), {i: r.n for i, r in asking.items()}, QUERIES)):
        needed, n = [], 0
        for s in summary:
            low, high = min(between[i, s.cell] - far[i] for i in own), max(between[i, s.cell] + far[i] for i in own)
            most = max(reach[i] for i in own)
            if low - most <= s.high and s.low <= high + most:
                needed.append((part, s.cell, float(low), float(high), float(most)))
                n += s.n
        splits = math.ceil(sum(asking[i].n for i in own) / QUERIES)
        slices = max(1, min(math.ceil(n / SLICE), max(4 * workers, math.ceil(n / LONG_SLICE))))
        data += [(*x, splits, slices) for x in needed]
        queries += [(i, part, splits, slices) for i in own]
    return data, queries


def solve(dealt: DataFrame, k: int, lifted: Lifted) -> DataFrame:
    """(query_row, query_id, row, id, score): the k best rows of each query in each (part, split, slice) of ``dealt``.

    A partition is sorted by these keys with the queries of each before its data and the data in order of their bound.
    """
    size = CHUNK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting = None, [], []
        q = own = best = None

        def begin() -> None:
            nonlocal q, own, best, held
            q = pa.Table.from_batches(held)
            v = matrix(q["v"], lifted.dim)
            own, best, held = (v, (v * v).sum(axis=1)), Best(len(v), k), []

        def search() -> None:
            nonlocal waiting
            if held:
                begin()
            if not waiting or best is None:
                waiting = []
                return
            chunk = pa.Table.from_batches(waiting)
            waiting = []
            v, bound = matrix(chunk["v"], lifted.dim), chunk["bound"][0].as_py()
            able = np.flatnonzero(lifted.distance(best.least.astype(np.float64), own[1]) + lifted.slack >= bound)
            if not len(able):
                return
            score = products(own[0][able], v)
            rows = chunk["row"].to_numpy()
            same = rows[None, :] == q["row"].to_numpy()[able][:, None]
            score[same] = np.iinfo(np.int64).min
            least = best.least[able]
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            at, which = np.nonzero((score >= least[:, None]) & ~same)
            ids, null = chunk["id"].fill_null(0).to_numpy(), chunk["id"].is_null().to_numpy()
            best.add(able[at], score[at, which], ids[which], null[which], rows[which])

        def told() -> Iterator[pa.RecordBatch]:
            search()
            if best is not None and len(best.query):
                asked = q.take(pa.array(best.query))
                yield pa.RecordBatch.from_arrays([asked["row"].combine_chunks(), asked["id"].combine_chunks(), pa.array(best.row), pa.array(best.id, mask=best.null), pa.array(best.score)], ["query_row", "query_id", "row", "id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*_KEY, "kind")]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns[:3])
                if now != key:
                    yield from told()
                    key, held, waiting, best = now, [], [], None
                (waiting if columns[3][a] else held).append(batch.slice(a, b - a))
                if sum(map(len, waiting)) >= size:
                    search()
        yield from told()

    spread = dealt.repartition(partitions(dealt.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "kind", "bound")
    return spread.mapInArrow(each, "query_row long, query_id long, row long, id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each row that ``is_query`` names."""
    session = prepare(vectors.sparkSession)
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("is_query"), whole(vector_col, scale).alias("v"))
    told = rows.agg(F.max(norm2("v")).alias("most"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    lifted = Lifted(told.most or 0.0, told.dim or 0)
    n_pivots = max(1, min(PIVOTS, math.isqrt(told.n), PIVOT_BYTES // (8 * (lifted.dim + 1))))
    drawn = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(n_pivots).toArrow()["v"] if told.n else pa.array([[]], pa.list_(pa.float64()))
    pivots = [lift(matrix(drawn, lifted.dim)) for lift in (lifted.data, lifted.query)]
    spots = assigned(rows, pivots, lifted)
    data, queries = plan(spots, pivots, k, lifted.slack)
    needs = session.createDataFrame(data, "part int, cell int, low double, high double, reach double, splits int, slices int")
    asks = session.createDataFrame(queries, "q_cell int, part int, splits int, slices int")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bound = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    given = spots.join(F.broadcast(needs), "cell").withColumn("bound", bound).where("bound <= reach")
    given = given.select("part", every("splits").alias("split"), deal("slices").alias("slice"), F.lit(1).alias("kind"), "bound", "row", "id", "v")
    asked = spots.where("is_query").join(F.broadcast(asks), "q_cell")
    asked = asked.select("part", deal("splits").alias("split"), every("slices").alias("slice"), F.lit(0).alias("kind"), F.lit(0.0).alias("bound"), "row", "id", "v")
    found = solve(given.union(asked), k, lifted)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
