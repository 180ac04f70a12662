"""Hard negatives by vantage-point trees.

Scores become distances by one more coordinate (``integers.Lifted``), so the rows of a score window lie in an annulus around
the anchor. A top tree over a bounded sample cuts space into regions by nested spheres around its vantage points; every row
belongs to one region, and the rows of a region are dealt to trees of some ``TREE_ROWS`` rows, so copies of one vector make
more trees, not larger ones. A tree is built once, in the task that holds its rows, and written as one row of a table: its
vectors, and the smallest and largest distance of both halves of each node to its vantage point.

An anchor walks a tree nearest first: a queue holds nodes by the best score that their distances allow and rows by score and
id, so rows leave it in the order of the result, and the walk ends after k of them. Nodes outside the annulus never enter. The
first walk takes rows of the anchor's label and no window and gives the positives, after the best of all trees are merged; the
second takes the rows of other labels in each positive's window, in the regions that meet its annulus.

Scale: the top tree has at most ``REGIONS`` regions and its sample ``SAMPLE`` rows; these are what the driver and every task
hold. Trees and anchors meet by tree and by ``ANCHORS`` anchors; a task holds one tree and streams anchors. In many dimensions
little is ruled out and the walks cost what comparing the anchors with all rows costs.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part; a window of a negative
positive score is empty; an anchor without another row of its label has no rows; repeated rows are rows of their own, each an
anchor or a candidate; a null id is no anchor, ranks behind others at equal scores and comes out null; an empty vector scores 0
with all; vectors of different lengths, very large components: see ``integers``; labels may be of any type; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, partitions, prepare
from millrace.llm.integers import Lifted, distances, matrix, norm2, products, usable, whole

#: Rows of the sample and regions of the top tree at most; bytes of the sample.
SAMPLE, REGIONS, SAMPLE_BYTES = 4096, 256, 16 << 20
#: Rows of a tree and of a leaf, about; anchors that meet a tree in one task.
TREE_ROWS, LEAF, ANCHORS = 4096, 512, 8192

_LEAST = np.iinfo(np.int64).min
_KEY = ["region", "slice", "split"]


class TopTree:
    """A full binary tree of spheres: inside or on the sphere to the left, outside to the right."""

    def __init__(self, sample: np.ndarray, regions: int):
        depth = max(0, min(math.ceil(math.log2(regions)), int(math.log2(max(len(sample), 1)))))
        self.depth, self.radius = depth, np.zeros((1 << depth) - 1)
        self.vantage = np.zeros(((1 << depth) - 1, sample.shape[1]))
        parts = {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            own = parts.pop(node)
            self.vantage[node] = sample[own[0]] if len(own) else 0
            far = distances(self.vantage[node : node + 1], sample[own])[0]
            self.radius[node] = np.median(far) if len(own) else 0
            parts[2 * node + 1], parts[2 * node + 2] = own[far <= self.radius[node]], own[far > self.radius[node]]

    def regions_of(self, rows: np.ndarray) -> np.ndarray:
        far, node = distances(rows, self.vantage), np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (far[np.arange(len(rows)), node] > self.radius[node])
        return node - ((1 << self.depth) - 1)

    def shells(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance (queries x regions) that each query can have to the rows of each region."""
        far, n = distances(queries, self.vantage), 1 << self.depth
        low, high = np.zeros((len(queries), 2 * n - 1)), np.full((len(queries), 2 * n - 1), np.inf)
        for node in range(n - 1):
            d, r = far[:, node], self.radius[node]
            for child, least, most in ((2 * node + 1, d - r, d + r), (2 * node + 2, r - d, np.inf)):
                low[:, child], high[:, child] = np.maximum(low[:, node], least), np.minimum(high[:, node], most)
        return low[:, n - 1 :], high[:, n - 1 :]


class Tree:
    """A balanced vantage-point tree: a node is a range of rows, its first one the vantage point, the nearer half before the farther.

    ``spans`` holds for each vantage point the least and largest distance of both halves.
    """

    def __init__(self, v: np.ndarray, lifted: Lifted, leaf: int, order: np.ndarray | None = None, spans: np.ndarray | None = None):
        self.v, self.lifted, self.leaf = v, lifted, leaf
        if order is None:
            raised, order, spans = lifted.data(v), np.arange(len(v)), np.zeros((len(v), 4))
            todo = [(0, len(v))]
            while todo:
                a, b = todo.pop()
                if b - a <= leaf:
                    continue
                far = distances(raised[order[a : a + 1]], raised[order[a + 1 : b]])[0]
                half = len(far) // 2
                near = np.argpartition(far, half)
                order[a + 1 : b], far = order[a + 1 : b][near], far[near]
                spans[a] = far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max()
                todo += [(a + 1, a + 1 + half), (a + 1 + half, b)]
            self.v = v[order]
        self.order, self.spans = order, spans

    def walk(self, q: np.ndarray, ids: np.ndarray, ok: np.ndarray, low: int, high: int, k: int, seen: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int]]:
        """(score, row) of the k first rows with ``ok`` and low <= score <= high, by score and then ``ids``, nearest first.

        ``seen`` keeps scores of ranges of rows for further walks of the same anchor.
        """
        own, slack = float(q @ q), self.lifted.slack
        queue: list[tuple] = [(-math.inf, 0, 0, 0, len(ids))]
        found: list[tuple[int, int]] = []

        def scores(a: int, b: int) -> np.ndarray:
            if (a, b) not in seen:
                seen[a, b] = products(q[None, :], self.v[a:b])[0]
            return seen[a, b]

        def score_of(distance: float) -> float:
            return (own + self.lifted.most - distance * distance) / 2

        def enter(a: int, b: int, s: np.ndarray) -> None:
            fit = np.flatnonzero(ok[a:b] & (s >= low) & (s <= high))
            if len(fit) > k:  # a walk yields k rows, so only the best k of a range can matter
                fit = fit[np.lexsort((ids[a:b][fit], ~s[fit]))[:k]]
            for i in fit.tolist():
                heapq.heappush(queue, (-int(s[i]), 1, int(ids[a + i]), a + i, 0))

        while queue:
            best, is_row, _, a, b = heapq.heappop(queue)
            if is_row:
                found.append((-best, a))
                if len(found) == k:
                    break
            elif b - a <= self.leaf:
                enter(a, b, scores(a, b))
            else:
                s = scores(a, a + 1)
                enter(a, a + 1, s)
                d, half = float(self.lifted.distance(float(s[0]), own)), (b - a - 1) // 2
                for c, e, least, most in ((a + 1, a + 1 + half, *self.spans[a, :2]), (a + 1 + half, b, *self.spans[a, 2:])):
                    near = max(least - d, d - most, 0.0) - slack
                    top = score_of(near) if near > 0 else math.inf
                    if top >= low and score_of(d + most + slack) <= high:
                        heapq.heappush(queue, (-top, 0, 0, c, e))
        return found


def trees_of(spots: DataFrame, lifted: Lifted) -> DataFrame:
    """One row for each (region, slice): its tree, with ids, labels and row numbers in the tree's order."""
    kind, leaf = dict(spots.dtypes)["label"], LEAF

    def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        built = Tree(matrix(rows["v"], lifted.dim), lifted, leaf)
        rows = rows.take(pa.array(built.order))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        column = lambda c: one(rows[c].combine_chunks())
        return pa.RecordBatch.from_arrays([rows["region"][:1].combine_chunks(), rows["slice"][:1].combine_chunks(), column("row"), column("id"), column("label"), one(pa.array(built.v.ravel())), one(pa.array(built.spans.ravel()))], ["region", "slice", "rows", "ids", "labels", "vectors", "spans"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            region, piece = (batch.column(c).to_numpy() for c in ("region", "slice"))
            changes = np.flatnonzero((region[1:] != region[:-1]) | (piece[1:] != piece[:-1])) + 1
            for a, b in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and key != (region[a], piece[a]):
                    yield tree(held)
                    held = []
                key = (region[a], piece[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield tree(held)

    dealt = spots.repartition(partitions(spots.sparkSession), "region", "slice").sortWithinPartitions("region", "slice", "row")
    return cut(dealt.select("region", "slice", "row", "id", "label", "v").mapInArrow(each, f"region int, slice int, rows array<long>, ids array<long>, labels array<{kind}>, vectors array<double>, spans array<double>"))


def located(rows: DataFrame, top: TopTree, lifted: Lifted) -> DataFrame:
    """``rows`` (id, is_anchor, label, v) with their region and a number of the row."""
    shared, names = rows.sparkSession.sparkContext.broadcast(top), ["id", "is_anchor", "label", "v", "region"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.regions_of(lifted.data(matrix(batch.column("v"), lifted.dim))), pa.int32())], names)

    return cut(rows.mapInArrow(each, f"id long, is_anchor boolean, label {dict(rows.dtypes)['label']}, v array<double>, region int").withColumn("row", F.monotonically_increasing_id()))


def with_regions(anchors: DataFrame, top: TopTree, lifted: Lifted) -> DataFrame:
    """``anchors`` (row, label, v, low, high) with the regions that meet the annulus of any window."""
    shared, fields = anchors.sparkSession.sparkContext.broadcast(top), ["row", "label", "v", "low", "high", "regions"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, regions = matrix(batch.column("v"), lifted.dim), []
            nearest, farthest = shared.value.shells(lifted.query(v))
            for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)):
                near, far = (lifted.distance(np.array(s, dtype=np.float64), float(v[i] @ v[i]))[:, None] for s in (high, low))
                meets = (nearest[i] <= far + lifted.slack) & (farthest[i] >= near - lifted.slack)
                regions.append(np.flatnonzero(meets.any(axis=0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(regions, pa.list_(pa.int32()))], fields)

    return anchors.mapInArrow(each, f"row long, label {dict(anchors.dtypes)['label']}, v array<double>, low array<long>, high array<long>, regions array<int>")


def search(trees: DataFrame, anchors: DataFrame, counts: DataFrame, n_anchors: int, same: bool, k: int, lifted: Lifted) -> DataFrame:
    """(anchor_row, window, row, id, score): for each window [low, high] of an anchor, the k best rows of every tree whose label is,
    with ``same``, the anchor's, and otherwise is not; a row never finds itself."""
    splits = max(1, math.ceil(n_anchors / ANCHORS))
    leaf = LEAF

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = rows = ids = null = labels = ranks = None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: B023, E731
                if not get("kind").as_py():
                    rows, labels = get("rows").values.to_numpy(), get("labels").values.to_numpy(zero_copy_only=False)
                    ids, null = get("ids").values.fill_null(0).to_numpy(), get("ids").values.is_null().to_numpy(zero_copy_only=False)
                    ranks = np.empty(len(rows), dtype=np.int64)
                    ranks[np.lexsort((rows, ids, null))] = np.arange(len(rows))
                    tree = Tree(get("vectors").values.to_numpy().reshape(len(rows), -1), lifted, leaf, rows, get("spans").values.to_numpy().reshape(-1, 4))
                    continue
                row, label, q, seen = get("row").as_py(), get("label").as_py(), np.zeros(lifted.dim), {}
                values = get("v").values.to_numpy()
                q[: len(values)] = values
                ok = ((labels == label) == same) & (rows != row)
                if ok.any():
                    for window, (low, high) in enumerate(zip(get("low").as_py(), get("high").as_py(), strict=True)):
                        out += [(row, window, score, at) for score, at in tree.walk(q, ranks, ok, low, high, k, seen)]
                if out and (i + 1 == batch.num_rows or not batch.column("kind")[i + 1].as_py()):
                    anchor, window, score, at = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window, pa.int32()), pa.array(rows[at]), pa.array(ids[at], mask=null[at]), pa.array(score)], ["anchor_row", "window", "row", "id", "score"])
                    out = []

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = anchors.withColumn("region", F.explode("regions")).join(counts, "region").withColumn("slice", every(F.col("slices")))
    asked = asked.select("region", "slice", F.pmod(F.xxhash64("row"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("kind"), "row", "label", "v", "low", "high")
    given = trees.select("region", "slice", every(F.lit(splits)).alias("split"), F.lit(0).alias("kind"), "rows", "ids", "labels", "vectors", "spans")
    both = given.unionByName(asked, allowMissingColumns=True).repartition(partitions(trees.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "kind")
    return both.mapInArrow(each, "anchor_row long, window int, row long, id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (anchor_row, window) with their rank, from 1."""
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an anchor's best ``positives`` rows of
    its label, the best ``negatives`` of other labels with least * positive_score <= 100 * score <= 100 * positive_score."""
    session = prepare(vectors.sparkSession)
    rows = vectors.where(usable(vector_col) & label.isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor"), label.alias("label"), whole(vector_col, scale).alias("v"))
    told = rows.agg(F.max(norm2("v")).alias("most"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    lifted = Lifted(told.most or 0.0, max(told.dim or 0, 1))
    n_sample = max(1, min(SAMPLE, told.n, SAMPLE_BYTES // (8 * (lifted.dim + 1))))
    drawn = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(n_sample).toArrow()["v"] if told.n else pa.array([[]], pa.list_(pa.float64()))
    top = TopTree(lifted.data(matrix(drawn, lifted.dim)), max(1, min(REGIONS, math.ceil(told.n / TREE_ROWS))))
    spots = located(rows, top, lifted)
    sizes = spots.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anchor").cast("long")).alias("anchors")).collect()
    n_anchors = sum(r.anchors for r in sizes)
    counts = F.broadcast(session.createDataFrame([(r.region, math.ceil(r.n / TREE_ROWS)) for r in sizes], "region int, slices int"))
    trees = trees_of(spots.join(counts, "region").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")), lifted)
    anchors = spots.where("is_anchor").select("row", "id", "label", "v")
    ends = lambda x: F.array(F.lit(x)).cast("array<long>")
    everywhere = F.array(*[F.lit(r.region) for r in sizes]).cast("array<int>")
    asked = anchors.select("row", "label", "v", ends(_LEAST).alias("low"), ends(~_LEAST).alias("high"), everywhere.alias("regions"))
    near = first(search(trees, asked, counts, n_anchors, True, positives, lifted), positives)
    near = cut(near.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near")))
    least_of = lambda p: F.ceil(p["score"].cast("decimal(38,0)") * least / F.lit(100).cast("decimal(38,0)")).cast("long")
    windows = anchors.join(near, "row").select("row", "label", "v", F.transform("near", least_of).alias("low"), F.transform("near", lambda p: p["score"]).alias("high"))
    found = first(search(trees, with_regions(windows, top, lifted), counts, n_anchors, False, negatives, lifted), negatives)
    named = anchors.select("row", F.col("id").alias("anchor_id")).join(near, "row").select(F.col("row").alias("anchor_row"), "anchor_id", F.posexplode("near").alias("window", "positive"))
    return found.join(named, ["anchor_row", "window"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
