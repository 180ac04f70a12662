"""Benchmark decontamination on a distributed positional inverted index.

Training documents are tokenised once. The terms that occur in the test items are indexed in segments, each with the
postings of some documents: the places of every term, sorted by term. Segments are built where the documents are read and
stored in the shared folder, so no text and no posting is shuffled, and a frequent term is spread over all segments.
Corpus frequencies are the sums of the segments' posting counts. A test window is looked up from its rarest term: that
term's places, shifted by its offset in the window, are intersected with the shifted places of the next rarest term, and so
on, until none is left or the phrase is complete. A proximity match asks for all terms of a window, each as often as in it
and in any order, within the window's length and a few words more.

Test items are taken in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast is bounded; each block is
a pass over all documents.

Defined cases: a null text has no words; an item without words has no window; an item of fewer words than the
window is one window; equal items match each on their own; ids of items and documents may be of any type, and a null document id stays null; an item without an id counts for hits and is not listed; repeated document rows give a row each; empty tables
give empty results, and without items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from millrace.llm.common import cut, prepare, without

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Words beyond its length that a window may spread over in the query's proximity matches.
PROXIMITY = 2
#: Postings after which a segment ends; a longer document is a segment of its own. Candidates that are checked at a time.
POSTINGS, CANDIDATES = 1 << 19, 1 << 19

_PLACES = (1 << 32) - 1

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII of the text with A-Z lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


def _key(term: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (term.astype(np.int64) << 32) | place


class Segment:
    """The postings of some documents: sorted (term, place) keys.

    Places count the words of all documents of the segment, with a spare one after each document.
    """

    def __init__(self, keys: np.ndarray, sizes: np.ndarray):
        self.keys, self.sizes = keys, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.term, self.place = keys >> 32, keys & _PLACES
        self.doc = self.doc_of(self.place)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1

    def at(self, key: np.ndarray) -> np.ndarray:
        """The first posting at or after ``key``, and the last one if there is none."""
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)]

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = _key(term, place)
        return self.at(key) == key

    def holds_within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether ``term`` has a place in [low, high)."""
        low, high = _key(term, low), _key(term, high)
        found = self.at(low)
        return (found >= low) & (found < high)


class Items:
    """The windows of a block of test items and the terms in them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, kind: pa.DataType | None = None):
        """``kind`` is the type of the items' ids, 64-bit numbers if it is left out."""
        self.terms: dict[bytes, int] = {}
        self.window = window
        lists, numbers = [], {}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            lists += [(item, ids[i : i + window]) for i in range(max(1, len(ids) - window + 1)) if ids]
        self.item = np.array([-1 if i is None else numbers.setdefault(i, len(numbers)) for i, _ in lists], dtype=np.int64)
        self.names = pa.array(list(numbers), kind or pa.int64())
        self.named = np.array([i is not None for i, _ in lists], dtype=bool)
        self.length = np.array([len(ids) for _, ids in lists], dtype=np.int64)
        self.ids = np.full((len(lists), window), -1, dtype=np.int32)
        for k, (_, ids) in enumerate(lists):
            self.ids[k, : len(ids)] = ids
        self.need = sum(((self.ids == self.ids[:, k : k + 1]).astype(np.int16) for k in range(window)), np.zeros(self.ids.shape, dtype=np.int16))

    def by_rarity(self, frequency: np.ndarray) -> None:
        """Order each window's offsets from its rarest term on, and list the windows by rarest term."""
        often = np.where(self.ids >= 0, frequency[np.maximum(self.ids, 0)], np.iinfo(np.int64).max) if len(self.ids) else np.zeros((0, self.window), dtype=np.int64)
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int16)
        first = self.ids[np.arange(len(self.ids)), self.order[:, 0]]
        self.at = np.argsort(first, kind="stable")
        self.start = np.searchsorted(first[self.at], np.arange(len(self.terms) + 1))

    def candidates(self, segment: Segment) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(posting, window) of every posting of each window's rarest term, about ``CANDIDATES`` at a time."""
        n_at = self.start[segment.term + 1] - self.start[segment.term]
        rare = np.flatnonzero(n_at)
        n_at = n_at[rare]
        for a, b in _slices(np.cumsum(n_at), CANDIDATES):
            p, n = rare[a:b], n_at[a:b]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(p, n), self.at[np.repeat(self.start[segment.term[p]], n) + offset]

    def phrases(self, segment: Segment) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, window) of every occurrence, in places of the segment."""
        for posting, which in self.candidates(segment):
            begin, first = segment.place[posting] - self.order[which, 0], segment.base[segment.doc[posting]]
            ok = (begin >= first) & (begin + self.length[which] <= first + segment.sizes[segment.doc[posting]])
            begin, which = begin[ok], which[ok]
            for k in range(1, self.window):  # intersect with the next rarest term's shifted places
                if not len(begin):
                    break
                shift = self.order[which, k]
                ok = (k >= self.length[which]) | segment.holds(self.ids[which, shift], begin + shift)
                begin, which = begin[ok], which[ok]
            if len(begin):
                yield begin, begin + self.length[which], which

    def near(self, segment: Segment, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, window) where all terms of a window, each as often as in it, lie within its length and ``slop`` words.

        A stretch starts at a term of the window and ends with its document at the latest.
        """
        for posting, which in self.candidates(segment):
            place, low = segment.place[posting], segment.base[segment.doc[posting]]
            high = low + segment.sizes[segment.doc[posting]]
            for k in range(1, self.window):  # some place of the next rarest term must be in reach
                if not len(which):
                    break
                wide = self.length[which] + slop
                term = self.ids[which, self.order[which, k]]
                ok = (k >= self.length[which]) | segment.holds_within(term, np.maximum(place - wide + 1, low), np.minimum(place + wide, high))
                place, which, low, high = place[ok], which[ok], low[ok], high[ok]
            for back in range(int(self.length[which].max()) + slop if len(which) else 0):
                begin, wide = place - back, self.length[which] + slop
                ok = (back < wide) & (begin >= low)
                begin, w, end = begin[ok], which[ok], np.minimum(begin + wide, high)[ok]
                starts = np.zeros(len(begin), dtype=bool)
                for k in range(self.window):
                    term, key = self.ids[w, k], _key(self.ids[w, k], begin)
                    at = np.searchsorted(segment.keys, key)
                    often = np.searchsorted(segment.keys, _key(term, end)) - at
                    starts |= segment.keys[np.minimum(at, len(segment.keys) - 1)] == key
                    ok = (term < 0) | (often >= self.need[w, k])
                    begin, w, end, starts = begin[ok], w[ok], end[ok], starts[ok]
                if starts.any():
                    yield begin[starts], end[starts], w[starts]


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose counts sum to about ``most``; ``ends`` is the running sum of the counts."""
    a = 0
    while a < len(ends):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield a, b
        a = b


def index(docs: DataFrame, items: Items) -> DataFrame:
    """Segments (doc_ids, sizes, marks, n, postings): some documents, their words and marks, and the n packed postings of the
    test items' terms in them. A mark is a hash of the text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.terms)

    def segment(ids: pa.Array, sizes: list[int], marks: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.sort(np.concatenate(keys))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        packed = pa.compress(np.diff(flat, prepend=0).tobytes(), codec="zstd", asbytes=True) if len(flat) else b""
        return pa.RecordBatch.from_arrays([one(ids), one(pa.array(sizes, pa.int64())), one(pa.array(marks, pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([packed], pa.binary())], ["doc_ids", "sizes", "marks", "n", "postings"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            first, base, held, sizes, marks, keys = 0, 0, 0, [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                marks.append(xxh64_intdigest((text or "").encode(), 42) >> 1)  # as _mark
                parts = words(text)
                ids = np.fromiter((get(w, -1) for w in parts), dtype=np.int64, count=len(parts))
                at = np.flatnonzero(ids >= 0)
                keys.append(_key(ids[at], at + base))
                sizes.append(len(parts))
                base, held = base + len(parts) + 1, held + len(at)
                if held >= POSTINGS or base >= _PLACES >> 2 or row + 1 == batch.num_rows:
                    yield segment(batch.column(0).slice(first, len(sizes)), sizes, marks, keys)
                    first, base, held, sizes, marks, keys = row + 1, 0, 0, [], [], []

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_ids array<{dict(docs.dtypes)['doc_id']}>, sizes array<long>, marks array<long>, n long, postings binary")


def _keys(n: int, postings: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(postings, 8 * n, codec="zstd", asbytes=True), dtype=np.int64)) if n else np.zeros(0, dtype=np.int64)


def frequencies(segments: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over all segments; one partial count for each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for n, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(_keys(n, postings) >> 32, minlength=n_terms)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for term, n in segments.select("n", "postings").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():
        out[term] = n
    return out


def blocks(bench: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """Items in order of their ids, as many at a time as hold ``most`` words together (one at least)."""
    block, size = [], 0
    for item, text in bench.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(words(text))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


_MATCHES = ("starts", "ends", "items", "near_starts", "near_ends", "near_items")
_ROW = ["doc_id", "n_words", *_MATCHES, "mark"]


def _schema(kind: str, items: str) -> str:
    """Of rows as ``_ROW``: ``kind`` is the type of document ids, ``items`` that of lists of items."""
    return f"doc_id {kind}, n_words long, {', '.join(f'{c} {items}' if c.endswith('items') else f'{c} array<long>' for c in _MATCHES)}, mark long"


def _scan(segments: DataFrame, items: Items, proximity: int | None, listed: str) -> DataFrame:
    """(doc_id, n_words, starts, ends, items, near_starts, near_ends, near_items, mark) of every document: the stretches of words
    that exact and, with ``proximity``, near matches cover, and the items found."""
    shared = segments.sparkSession.sparkContext.broadcast(items)

    def told(segment: Segment, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        items, n = shared.value, len(segment.sizes)
        begin, end, which = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        named = items.named[which]
        pairs = np.unique(np.stack([segment.doc_of(begin[named]), items.item[which[named]]]), axis=1)
        begin, end = merge(begin, end)
        doc = segment.doc_of(begin)
        lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(n + 1)), pa.int32()), items.names.take(pa.array(pairs[1])))
        return [lists(doc, begin - segment.base[doc]), lists(doc, end - segment.base[doc]), found]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, marks = (batch.column(k)[row].values for k in range(3))
                segment = Segment(_keys(batch.column(3)[row].as_py(), batch.column(4)[row].as_py()), sizes.to_numpy())
                exact = told(segment, list(items.phrases(segment)))
                near = told(segment, [] if proximity is None else list(items.near(segment, proximity)))
                yield pa.RecordBatch.from_arrays([ids, sizes, *exact, *near, marks], _ROW)

    return segments.mapInArrow(each, _schema(dict(segments.dtypes)["doc_ids"][len("array<") : -1], listed))


def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that the intervals cover."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begin) - 1]])
    return begin[new], reach[last]


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, proximity: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) of every row of ``docs`` (doc_id, text).

    starts and ends bound the stretches of words inside occurrences, items lists the items that occur. With
    ``proximity`` a window occurs where its terms lie, in any order, within that many words more than its length.
    """
    kind = "" if proximity is None else "near_"
    return _found(docs, bench, window, proximity, block_words).select("doc_id", "n_words", *[F.col(kind + c).alias(c) for c in ("starts", "ends", "items")])


def _mark(text: Column) -> Column:
    """The hash of a text that ``index`` keeps."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def _found(docs: DataFrame, bench: DataFrame, window: int, proximity: int | None, block_words: int) -> DataFrame:
    prepare(docs.sparkSession)
    parts, kind, listed = [], to_arrow_type(bench.schema["item_id"].dataType), f"array<{dict(bench.dtypes)['item_id']}>"
    for block in blocks(bench, block_words):
        items = Items(block, window, kind)
        segments = cut(index(docs, items))
        items.by_rarity(frequencies(segments, len(items.terms)))
        parts.append(_scan(segments, items, proximity, listed))
    if not parts:
        parts.append(_scan(index(docs, empty := Items([], window, kind)), _ordered(empty), proximity, listed))
    return parts[0] if len(parts) == 1 else union_of(parts)


def _ordered(items: Items) -> Items:
    items.by_rarity(np.zeros(len(items.terms), dtype=np.int64))
    return items


def union_of(parts: list[DataFrame]) -> DataFrame:
    """One row for each document from the rows of several passes. Rows that repeat an id and a text come back as often."""

    def merged(starts: pa.Array, ends: pa.Array) -> list[pa.Array]:
        rows = [merge(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True)]
        return [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(2)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column
            yield pa.RecordBatch.from_arrays([column(0), column(1), *merged(column(2), column(3)), column(4), *merged(column(5), column(6)), column(7), column(8)], _ROW)

    both = reduce(DataFrame.unionByName, parts)
    gathered = [F.flatten(F.collect_list(c)).alias(c) for c in _MATCHES if not c.endswith("items")]
    gathered += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in _MATCHES if c.endswith("items")]
    grouped = both.groupBy("doc_id", "n_words", "mark").agg(*gathered, F.count(F.lit(1)).alias("n"))
    again = grouped.withColumn("_", F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int"))))
    return again.select(*_ROW).mapInArrow(each, _schema(dict(both.dtypes)["doc_id"], dict(both.dtypes)["items"]))


def digest(docs: DataFrame, bench: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """The contract's columns and n_near, the items of which a window lies within its length and ``proximity`` words."""
    found = _found(docs, bench, WINDOW, proximity, BLOCK_WORDS)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text a window occurs, null ids and other texts under the same id told apart."""
    hit = _found(docs, bench, WINDOW, None, BLOCK_WORDS).where(F.size("starts") > 0)
    bad = cut(hit.select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_mark")).distinct())
    return without(docs, bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (_mark(docs["text"]) == bad["_mark"]))
