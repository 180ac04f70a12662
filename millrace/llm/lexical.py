"""Ranked lexical search by block-max pruning.

Documents are tokenised once, where they are read. Of each document the index keeps its number of words and the query terms in it
with their counts (the forward index). Documents form blocks of consecutive ones, and ``SEGMENT`` documents or some postings
make a segment, a row of the index in the shared folder. Counts over all documents (documents with words, words, documents
that hold a term) come from one pass over the segments. They fix a term's weight and what an occurrence adds to a score, and
the second pass adds the maxima of each term to every block and gathers, for each term, the ``k``-th largest addition over all
documents: a query's k-th score is at least the largest of these times the term's weight.

A query takes the blocks of a segment in order of the bound that their maxima give it, scores the documents of a block from
the forward index, and stops at the first block whose bound is below its threshold, the larger of the corpus-wide start and
its own k-th score in this task. Blocks whose bound equals the threshold are scored, since ties go to the smaller id.

Scale: the index is never shuffled; what leaves a task is k rows a query. Queries are taken in blocks of at most
``QUERY_WORDS`` words, so what is broadcast is bounded (some 100 bytes a different term); each block is a pass over all documents.

Defined cases: a null text, or one without words, has no terms and is not counted; a query without terms, or whose terms occur
nowhere, has no rows; repeated document rows are documents of their own; a null document id ranks behind others at equal scores;
a null query id is an id like any other, and equal ids are queries of their own; ids may be of any type; further columns are
ignored; very long texts are taken whole; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, prepare
from millrace.llm.decontam import words

QUERY_WORDS = 2_000_000
#: Documents of a block and of a segment; postings after which a segment ends earlier.
BLOCK, SEGMENT, POSTINGS = 32, 2048, 1 << 20

_INDEX = "ids array<{kind}>, lengths array<long>, starts array<long>, terms array<int>, counts array<long>"
_FORWARD = ["ids", "lengths", "starts", "terms", "counts"]


class Queries:
    """A block of queries: their terms as numbers, each with the times it is asked for."""

    def __init__(self, texts: list[str | None]):
        self.terms: dict[bytes, int] = {}
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            own = np.array([self.terms.setdefault(w, len(self.terms)) for w in words(text)], dtype=np.int64)
            self.asked.append(np.unique(own, return_counts=True))


class Statistics:
    """N documents with terms, L terms in all, df documents of each term: weights and additions."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.total, self.df = n, total, df
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def addition(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term that occurs ``counts`` times in a document of this length adds to a score, before its weight."""
        m = 25 + 75 * lengths * self.n // max(self.total, 1)
        return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def blocks_of_queries(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(id, text), as many at a time as hold ``most`` words together (one at least); a text without words counts as one."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        n = max(1, len(words(row[1])))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block


def _list(values: pa.Array | np.ndarray) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Segments of the forward index: ids and words of documents, where each one's postings start, and the postings (term, count)."""
    kind, long, most = dict(docs.dtypes)["id"], SEGMENT, POSTINGS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.terms.get
        ids, lengths, terms, counts, held = [], [], [], [], 0

        def own_ids(batch: pa.RecordBatch, a: int, b: int) -> pa.Array:
            return batch.column(0).take(pa.array(range(a, b)))  # a copy: a slice would hold the texts of its batch

        def segment() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
            every = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
            return pa.RecordBatch.from_arrays([_list(every), _list(np.array(lengths, dtype=np.int64)), _list(starts), _list(np.concatenate(terms).astype(np.int32)), _list(np.concatenate(counts))], _FORWARD)

        for batch in batches:
            first = 0
            for row, text in enumerate(batch.column(1)):
                parts = words(text.as_py())
                own = np.fromiter((get(w, -1) for w in parts), dtype=np.int64, count=len(parts))
                term, count = np.unique(own[own >= 0], return_counts=True)
                lengths.append(len(parts))
                terms.append(term)
                counts.append(count.astype(np.int64))
                held += len(term)
                if held >= most or len(lengths) == long:
                    ids.append(own_ids(batch, first, row + 1))
                    yield segment()
                    first, ids, lengths, terms, counts, held = row + 1, [], [], [], [], 0
            if first < batch.num_rows:
                ids.append(own_ids(batch, first, batch.num_rows))
        if lengths:
            yield segment()

    return docs.select("id", "text").mapInArrow(each, _INDEX.format(kind=kind))


def _numbers(batch: pa.RecordBatch | pa.Table, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def statistics(segments: DataFrame, n_terms: int) -> Statistics:
    """Counts over all documents, one partial row a task and term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = _numbers(batch, "lengths", row)
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
                df += np.bincount(_numbers(batch, "terms", row), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen], pa.int64()), pa.array([n, total, *df[seen]], pa.int64())], ["term", "n"])

    df, whole = np.zeros(n_terms, dtype=np.int64), {-2: 0, -1: 0}
    for term, n in segments.select("lengths", "terms").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():
        if term < 0:
            whole[term] = n
        else:
            df[term] = n
    return Statistics(whole[-2], whole[-1], df)


def block_maxima(block: np.ndarray, terms: np.ndarray, addition: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(different terms, blocks x terms of maxima): the largest addition of each term in each block of a segment, 0 where it does not occur."""
    present, at = np.unique(terms, return_inverse=True)
    out = np.zeros((n_blocks, len(present)), dtype=np.int64)
    np.maximum.at(out, (block, at), addition)
    return present, out


def with_maxima(segments: DataFrame, stats: Broadcast) -> DataFrame:
    """Segments with what each posting adds and the sparse maxima (block, term, most) of their blocks."""
    size = BLOCK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, starts, terms, counts = (_numbers(batch, c, row) for c in _FORWARD[1:])
                doc = np.repeat(np.arange(len(lengths)), np.diff(starts))
                addition = stats.value.addition(counts, lengths[doc])
                present, most = block_maxima(doc // size, terms, addition, -(-len(lengths) // size))
                block, at = np.nonzero(most)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(row, 1), *(_list(x) for x in (starts, terms, addition, block.astype(np.int32), present[at].astype(np.int32), most[block, at]))],
                    ["ids", "starts", "terms", "additions", "max_block", "max_term", "max"],
                )

    kind = dict(segments.dtypes)["ids"]
    return segments.mapInArrow(each, f"ids {kind}, starts array<long>, terms array<int>, additions array<long>, max_block array<int>, max_term array<int>, max array<long>")


def starting_points(blocks: DataFrame, n_terms: int, k: int) -> np.ndarray:
    """The k-th largest addition of each term over all documents, 0 where fewer hold it; k numbers a task and term are merged."""

    def largest(term: np.ndarray, addition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((-addition, term))
        term, addition = term[order], addition[order]
        keep = np.arange(len(term)) - np.searchsorted(term, term) < k
        return term[keep], addition[keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, addition = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                term, addition = largest(np.concatenate([term, _numbers(batch, "terms", row)]), np.concatenate([addition, _numbers(batch, "additions", row)]))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(addition)], ["term", "addition"])

    order = Window.partitionBy("term").orderBy(F.desc("addition"))
    found = blocks.select("terms", "additions").mapInArrow(each, "term int, addition long")
    out = np.zeros(n_terms, dtype=np.int64)
    for term, addition in found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == k).select("term", "addition").toLocalIterator():
        out[term] = addition
    return out


def search(blocks: DataFrame, queries: Broadcast, stats: Broadcast, start: np.ndarray, k: int) -> DataFrame:
    """(query, id, score): each task's k best documents of every query."""
    kind, size = dict(blocks.dtypes)["ids"][len("array<") : -1], BLOCK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = queries.value.asked, stats.value.weight
        gain = [weight[t] * n for t, n in asked]
        threshold = np.array([max([1, *(g * start[t]).tolist()]) for (t, _), g in zip(asked, gain, strict=True)], dtype=np.int64)
        n_terms = len(weight)
        place = np.full(n_terms, -1, dtype=np.int64)  # a term's number in the segment at hand
        best: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0, dtype=np.int64), None)] * len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, starts, terms, additions = batch.column("ids")[row].values, *(_numbers(batch, c, row) for c in ("starts", "terms", "additions"))
                present = np.unique(_numbers(batch, "max_term", row))
                place[present] = np.arange(len(present))
                n_blocks = -(-len(ids) // size)
                most = np.zeros((len(present), n_blocks), dtype=np.int64)
                most[place[_numbers(batch, "max_term", row)], _numbers(batch, "max_block", row)] = _numbers(batch, "max", row)
                at, wanted = place[terms], np.zeros(len(present), dtype=np.int64)
                for q, ((own, _), g) in enumerate(zip(asked, gain, strict=True)):
                    here = place[own] >= 0
                    if not here.any():
                        continue
                    own, g = place[own[here]], g[here]
                    bound = g @ most[own]
                    wanted[own] = g
                    scores, found = best[q]
                    for b in np.argsort(-bound, kind="stable"):
                        if bound[b] < threshold[q]:
                            break
                        first, last = b * size, min((b + 1) * size, len(ids))
                        gained = np.concatenate([[0], np.cumsum(wanted[at[starts[first] : starts[last]]] * additions[starts[first] : starts[last]])])
                        score = np.diff(gained[starts[first : last + 1] - starts[first]])
                        hit = np.flatnonzero(score >= threshold[q])
                        if len(hit):
                            new = ids.take(pa.array(first + hit))
                            scores, found = np.concatenate([scores, score[hit]]), new if found is None else pa.concat_arrays([found, new])
                            order = pa.compute.sort_indices(pa.table({"s": scores, "i": found}), sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end")[:k]
                            scores, found = scores[order.to_numpy()], found.take(order)
                            if len(scores) == k:
                                threshold[q] = max(threshold[q], scores[-1])
                    best[q] = scores, found
                    wanted[own] = 0
                place[present] = -1
        some = [q for q, (s, _) in enumerate(best) if len(s)]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, [len(best[q][0]) for q in some]), pa.int64()), pa.concat_arrays([best[q][1] for q in some]), pa.array(np.concatenate([best[q][0] for q in some]))], ["query", "id", "score"])

    return blocks.mapInArrow(each, f"query long, id {kind}, score long")


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, doc_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above score 0 of every query."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_col).alias("item_id"), F.col(text_col).alias("text"))
    kinds, parts = (dict(asked.dtypes)["item_id"], dict(docs.dtypes)["id"]), []
    for block in blocks_of_queries(asked, query_words):
        held = Queries([text for _, text in block])
        shared, n_terms = spark.sparkContext.broadcast(held), len(held.terms)
        segments = cut(index(docs, shared))
        stats = spark.sparkContext.broadcast(statistics(segments, n_terms))
        blocks = cut(with_maxima(segments, stats))
        found = search(blocks, shared, stats, starting_points(blocks, n_terms, k), k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"query long, item_id {kinds[0]}")
        parts.append(best.join(names, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return reduce(DataFrame.union, parts)
