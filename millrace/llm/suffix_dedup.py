"""Removal of repeated byte strings, decided by suffix arrays from a linear grouping construction.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or
earlier in the same document.

Every window of ``length`` bytes holds one anchor, the leftmost of its ``length // 2 - 2``-byte grams with the least
hash, so equal windows have equal anchors at equal places, and all windows around one anchor occurrence form one
stretch of text. The first pass keeps the anchors that occur twice, as a bit filter of bounded size: a full filter
lets more through but loses nothing. The second compares the stretches around these anchors by hash: each but the
earliest of equal ones goes, and the earliest of every kind are named where an anchor has several kinds of
surroundings. The third sends just these, a few per cent of the text, to buckets by anchor. There, cut into symbols
on both sides of their anchors, they make two texts whose suffix arrays order them by what follows and by what
precedes the anchor; common-prefix lengths of neighbours say which windows are equal, and all but the earliest of
each class go. Before the exchanges, equal stretches of a batch collapse to the earliest, so that a passage in very
many documents costs a row per batch.

The texts are read eight bytes to a symbol, so the suffix arrays order the stretches' own bytes; which whole
stretches are equal is told by 128 bits of hash before. The suffix array is built in two phases. Suffixes are grouped by Lyndon prefix, groups in descending order: the
members of a group extend the previous smaller suffixes that they point to, which split off into groups of their
own. Then each group's order is emitted in one pass over the array.

Defined cases: a null text is empty; documents shorter than the string lose nothing. Rows that share a doc_id and
a text are one document and lose the same bytes; rows that share a doc_id but not the text are different documents,
neither of them earlier. A null doc_id comes after all others (as does 2^63 - 1, which is taken for it). doc_id may
be of any type with an order. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, partitions, per_group, prepare

LENGTH = 100
#: Bytes of one text that are hashed at a time.
CHUNK = 1 << 18
#: Places within what is hashed at a time.
PLACES = (1 << 21) - 1
#: Bits of the filter of repeated anchors: about 12 for each anchor, this many at most (64 MB).
MOST_BITS = 1 << 29

_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_of(length: int) -> int:
    return max(1, length // 2 - 2)


# --- suffix array by grouping -------------------------------------------------------------------------------


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (integers) in lexicographic order; a shorter one comes first."""
    n = len(symbols) + 1  # with an end smaller than all symbols
    order = sorted(set(symbols))
    place = {s: k + 1 for k, s in enumerate(order)}
    group = [place[s] for s in symbols] + [0]
    members: list[list[int]] = [[] for _ in range(len(order) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(order)))
    above = [*range(1, len(order) + 1), -1]
    left = list(range(n))  # for a suffix whose group is done: towards the nearest one to the left that is not
    previous = [-1] * n
    now = len(order)
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            left[i] = i - 1
        count: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and left[p] != p:
                q = left[p]
                if q >= 0:
                    left[p] = left[q]
                p = q
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            split: dict[tuple[int, int], int] = {}
            for p in sorted(count, key=count.__getitem__, reverse=True) if len(count) > 1 else count:
                old = group[p]
                key = (old, count[p])
                new = split.get(key)
                if new is None:  # right above the group it leaves, below those with more repeats
                    new = split[key] = len(members)
                    members.append([])
                    over = above[old]
                    below.append(old)
                    above.append(over)
                    above[old] = new
                    below[over] = new
                members[new].append(p)
                group[p] = new
        now = below[now]
    free, at, now = [0] * len(members), 0, 0
    while now >= 0:
        free[now] = at
        at += len(members[now])
        now = above[now]
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]


# --- anchors ------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive bytes, by doubling the length of what is hashed."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    block = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    block ^= block >> np.uint64(29)
    size, done, out = 1, 0, None
    while True:
        if gram & size:
            out = block if out is None else out[: len(block) - done] * power(size) + block[done:]
            done += size
        if done == gram:
            break
        block = block[:-size] * power(size) + block[size:]
        size *= 2
    out = out[: len(data) - gram + 1] * _MIX
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(row, offset, data) of texts joined to about CHUNK bytes; a longer text comes in pieces that overlap by a window."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            part = text[at : at + CHUNK + length - 1]
            if parts and size + len(part) > CHUNK:
                yield np.repeat(rows, [len(p) for p in parts]), np.concatenate([np.arange(o, o + len(p)) for o, p in zip(offsets, parts, strict=True)]), b"".join(parts)
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.repeat(rows, [len(p) for p in parts]), np.concatenate([np.arange(o, o + len(p)) for o, p in zip(offsets, parts, strict=True)]), b"".join(parts)


_POWERS: list[np.ndarray] = []
_ONE = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base modulo 2 ** 64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([_ONE, np.full(max(n, 1 << 16) - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """One entry for each stretch of windows with one anchor: hash of the anchor's gram, hash of the stretch and
    its anchor's place in it, row of the text, place of the anchor, first window, last window."""
    gram = gram_of(length)
    width = length - gram + 1
    found: list[list[np.ndarray]] = []
    for row, offset, joined in segments(texts, length):
        data = np.frombuffer(joined, dtype=np.uint8)
        h = gram_hashes(data, gram)
        best, size = (h & ~np.uint64(PLACES)) | np.arange(len(h), dtype=np.uint64), 1  # equal hashes: the leftmost
        while 2 * size <= width:
            best = np.minimum(best[size:], best[:-size])
            size *= 2
        n = len(h) - width + 1
        best = (np.minimum(best[:n], best[width - size : width - size + n]) & np.uint64(PLACES)).astype(np.int64)
        inside = (row[:n] == row[length - 1 :]) & (offset[length - 1 :] - offset[:n] == length - 1)
        new = np.concatenate([[True], (best[1:] != best[:-1]) | (inside[1:] != inside[:-1]) | (row[1:n] != row[: n - 1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        at = best[first]
        up, down = powers(len(data))
        sums = np.concatenate([_ONE - _ONE, np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _MIX * up, dtype=np.uint64)])
        c = (sums[last + length] - sums[first]) * down[first]
        c = (c ^ (c >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + ((at - first) * 65537 + (last - first)).astype(np.uint64) * _MIX
        found.append([h[at], c ^ (c >> np.uint64(29)), row[first], offset[at], offset[first], offset[last]])
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return [none.astype(np.uint64), none.astype(np.uint64), none, none, none, none]
    return [np.concatenate([f[k] for f in found]) for k in range(6)]


def encoded(text: str | None) -> bytes:
    return (text or "").encode()


# --- packing ------------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers of one length, then bytes of any length, in one compressed string."""
    body = b"".join(a.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes, n_arrays: int) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    body = pa.decompress(data[16:], size, codec="zstd", asbytes=True)
    return [np.frombuffer(body, dtype=np.int64, count=n, offset=8 * n * k) for k in range(n_arrays)] + [np.frombuffer(body, dtype=np.uint8, offset=8 * n * n_arrays)]


class Filter:
    """A bit filter in one slice for each bucket of hashes."""

    def __init__(self, bucket_bits: int, bits: int):
        self.bucket_bits, self.slice_bits = bucket_bits, max(64, bits >> bucket_bits)
        self.bytes = np.zeros(self.slice_bits // 8 << bucket_bits, dtype=np.uint8)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        """Bit numbers within the slice, one array for each of two hash functions."""
        return [((h * np.uint64(c) >> np.uint64(24)) & np.uint64(self.slice_bits - 1)).astype(np.int64) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def slice_of(self, h: np.ndarray) -> bytes:
        flags = np.zeros(self.slice_bits, dtype=np.uint8)
        for at in self.places(h):
            flags[at] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def put(self, bucket: int, data: bytes) -> None:
        size = self.slice_bits // 8
        self.bytes[bucket * size : (bucket + 1) * size] = np.frombuffer(data, dtype=np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        base = bucket_of(h, self.bucket_bits) * self.slice_bits
        ok = np.ones(len(h), dtype=bool)
        for at in self.places(h):
            at = base + at
            ok &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def bucket_of(h: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Buckets of even size: anchors are least hashes, so the hashes themselves crowd near zero."""
    return (h * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - bucket_bits)).astype(np.int64)


# --- equal windows within a bucket --------------------------------------------------------------------------


def adjacent_common(order: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For rows in ``order``: bytes of ``tail`` shared with the row before, -1 if ``head`` differs."""
    same = tail[order[1:]] == tail[order[:-1]]
    shared = np.where(same.all(axis=1), tail.shape[1], np.argmin(same, axis=1)) if tail.shape[1] else np.zeros(len(order) - 1, dtype=np.int64)
    return np.concatenate([[-1], np.where(head[order[1:]] == head[order[:-1]], shared, -1)])


def ordered(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Rows sorted by (head, tail) through a suffix array over all rows' text: the head as a negative symbol, then
    the bytes of the tail, eight to a symbol."""
    n, width = tail.shape
    padded = np.zeros((n, -(-max(width, 1) // 8) * 8), dtype=np.uint8)
    padded[:, :width] = tail
    symbols: list[int] = []
    for mark, own in zip((head - int(head.max()) - 1).tolist(), padded.view(">u8").tolist(), strict=True):
        symbols.append(mark)
        symbols += own
    found = np.array(suffix_array(symbols), dtype=np.int64)
    stride = 1 + padded.shape[1] // 8
    return found[found % stride == 0] // stride


def repeated_windows(stretches: list[bytes], before: np.ndarray, length: int, doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """(n, length - gram + 1) flags: the window that starts o bytes before the anchor has an earlier equal.

    ``before``: bytes of each stretch that precede its anchor. Rows come by ``doc``, ``mark`` and place.
    """
    gram, n = gram_of(length), len(stretches)
    reach = length - gram
    head = np.zeros((n, gram), dtype=np.uint8)
    right, left = np.zeros((n, reach), dtype=np.uint8), np.zeros((n, reach), dtype=np.uint8)
    last = np.zeros(n, dtype=np.int64)
    for k, (s, at) in enumerate(zip(stretches, before.tolist(), strict=True)):
        row = np.frombuffer(s, dtype=np.uint8)
        head[k] = row[at : at + gram]
        tail = row[at + gram :]
        right[k, : len(tail)] = tail
        left[k, :at] = row[:at][::-1]
        last[k] = len(s) - length
    _, anchor = np.unique(head.view(f"V{gram}").ravel(), return_inverse=True)
    anchor = anchor.ravel()
    classes = []
    for tail in (left, right):
        order = ordered(anchor, tail)
        classes.append((order, adjacent_common(order, anchor, tail)))
    flags = np.zeros((n, reach + 1), dtype=bool)
    own = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    mixed = len(np.unique(doc)) <= own[-1]  # texts that share an id
    for o in range(reach + 1):
        valid = np.flatnonzero((o <= before) & (o >= before - last))
        if len(valid) < 2:
            continue
        codes = []
        for (order, shared), depth in zip(classes, (o, reach - o), strict=True):
            code = np.empty(n, dtype=np.int64)
            code[order] = np.cumsum(shared < depth)
            codes.append(code[valid])
        _, first, inverse = np.unique(codes[0] * (n + 1) + codes[1], return_index=True, return_inverse=True)
        leader = first[inverse.ravel()]
        flags[valid, o] = leader != np.arange(len(valid))
        if mixed:
            _, first, inverse = np.unique(leader * (n + 1) + own[valid], return_index=True, return_inverse=True)
            flags[valid, o] = (doc[valid] != doc[valid[leader]]) | (first[inverse.ravel()] != np.arange(len(valid)))
    return flags


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def resolve(h: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, length: int) -> Spans:
    """(doc, mark, from, to) of bytes to remove, from stretches (windows first..last around the anchor ``at``)."""
    sizes = last - first + length
    starts = np.concatenate([[0], np.cumsum(sizes)])
    whole = text.tobytes()
    order = np.lexsort((at, mark, doc))
    seen: dict[tuple[int, int, bytes], tuple[int, dict[int, int]]] = {}  # stretch: its first document, first place by text
    groups: dict[int, list[int]] = {}
    repeats = []
    for k in order.tolist():
        key = (int(h[k]), int(at[k] - first[k]), whole[starts[k] : starts[k + 1]])
        known, places = seen.setdefault(key, (int(doc[k]), {}))
        fresh = int(mark[k]) not in places
        if known != doc[k] or places.setdefault(int(mark[k]), int(at[k])) != at[k]:
            repeats.append(k)
        elif fresh:
            groups.setdefault(key[0], []).append(k)
    out = [(doc[repeats], mark[repeats], first[repeats], last[repeats] + length)] if repeats else []
    several = [k for g in groups.values() if len(g) > 1 for k in g]
    if several:
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        several = np.array(sorted(several, key=rank.__getitem__))
        flags = repeated_windows([whole[starts[k] : starts[k + 1]] for k in several], (at - first)[several], length, doc[several], mark[several])
        padded = np.zeros((len(several), flags.shape[1] + 2), dtype=np.int8)
        padded[:, 1:-1] = flags[:, ::-1]  # by rising start
        step = np.diff(padded, axis=1)
        row, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        base = at[several][row] - (flags.shape[1] - 1)
        out.append((doc[several][row], mark[several][row], base + begin, base + end - 1 + length))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def later(h: np.ndarray, c: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches sorted by (h, c, doc, mark, at): which have an earlier equal, which are new kinds, which are repeated rows.

    An equal is earlier in a smaller document, or at a smaller place of the same one.
    """
    if not len(h):
        none = np.zeros(0, dtype=bool)
        return none, none, none
    true = np.ones(1, dtype=bool)
    kind = np.concatenate([true, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    own = kind | np.concatenate([true, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    leader, mine = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (kind, own))
    behind = (doc != doc[leader]) | (at != at[mine])
    return behind, kind, ~own & ~behind


def copies(h: np.ndarray, c: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[Spans, np.ndarray]:
    """Bytes to remove where a stretch has an earlier equal, and names of the first stretches of anchors with several.

    ``c`` is a hash of the stretch: with the anchor's own hash, 128 bits tell stretches apart.
    """
    order = np.lexsort((at, mark, doc, c, h))
    h, c, doc, mark, at, first, last = (x[order] for x in (h, c, doc, mark, at, first, last))
    behind, kind, _ = later(h, c, doc, mark, at)
    anchor = np.concatenate([[True], h[1:] != h[:-1]])
    kinds = np.bincount(np.cumsum(anchor) - 1, weights=kind)
    unlike = ~behind & (kinds[np.cumsum(anchor) - 1] > 1)
    return (doc[behind], mark[behind], first[behind], last[behind] + length), np.unique(name_of(h[unlike], doc[unlike], mark[unlike], at[unlike]))


def name_of(h: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash that names one occurrence of an anchor."""
    x = h ^ (doc.astype(np.uint64) * _MIX + at.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) ^ mark.view(np.uint64)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


# --- distributed passes -------------------------------------------------------------------------------------


def by_bucket(h: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its hashes) for the buckets that have some."""
    buckets = bucket_of(h, bucket_bits)
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange((1 << bucket_bits) + 1))
    for bucket in np.flatnonzero(np.diff(bounds)):
        yield int(bucket), order[bounds[bucket] : bounds[bucket + 1]]


def rows_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def filter_of(hashes: DataFrame, bucket_bits: int) -> Filter:
    """A filter that holds the anchors in (bucket, n, hashes binary). Its slices are made on the executors."""
    n = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    kept = Filter(bucket_bits, min(MOST_BITS, 1 << (12 * n + 64).bit_length()))
    slim = Filter(bucket_bits, 0)
    slim.slice_bits = kept.slice_bits

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of([(k, slim.slice_of(np.frombuffer(b, dtype=np.uint64))) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    for bucket, data in hashes.where("n > 0").select("bucket", "hashes").mapInArrow(slices, "bucket long, data binary").toLocalIterator():
        kept.put(bucket, bytes(data))
    return kept


def repeated_anchors(docs: DataFrame, length: int, bucket_bits: int) -> Filter:
    """A filter that holds every anchor that occurs twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.sort(anchors([encoded(t) for t in batch.column(2).to_pylist()], length)[0])
            keep = np.ones(len(h), dtype=bool)
            keep[2:] = h[2:] != h[:-2]  # twice is enough
            h = h[keep]
            yield rows_of([(b, h[own].tobytes()) for b, own in by_bucket(h, bucket_bits)])

    def twice(group: pd.DataFrame) -> pa.RecordBatch:
        h = np.sort(np.frombuffer(b"".join(group["data"]), dtype=np.uint64))
        again = np.unique(h[1:][h[1:] == h[:-1]])
        return pa.RecordBatch.from_arrays([pa.array([int(group["bucket"].iloc[0])], pa.int64()), pa.array([len(again)], pa.int64()), pa.array([again.tobytes()], pa.binary())], ["bucket", "n", "hashes"])

    return filter_of(cut(per_group(docs.mapInArrow(emit, "bucket long, data binary"), ["bucket"], twice, "bucket long, n long, hashes binary")), bucket_bits)


def removals(docs: DataFrame, length: int, bucket_bits: int) -> DataFrame:
    """(_doc, _mark, cuts binary): byte ranges to remove, from and to in one number, apart from each other and in order.

    ``docs`` is (_doc long, _mark long, text): a number that orders documents, and a hash of the text.
    """
    context = docs.sparkSession.sparkContext
    repeated = context.broadcast(repeated_anchors(docs, length, bucket_bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, row, at, first, last = anchors([encoded(t) for t in batch.column(2).to_pylist()], length)
            some = repeated.value.holds(h)
            h, c, row, at, first, last = (x[some] for x in (h, c, row, at, first, last))
            doc, mark = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            order = np.lexsort((at, mark, doc, c, h))  # the earliest of equal stretches goes on, the others are copies for sure
            h, c, doc, mark, at, first, last = (x[order] for x in (h, c, doc, mark, at, first, last))
            lost, _, again = later(h, c, doc, mark, at)
            new = ~lost & ~again
            columns = [x[new] for x in (h.view(np.int64), c.view(np.int64), doc, mark, at, first, last)]
            yield rows_of([(k, packed(*(x[own] for x in columns))) for k, own in by_bucket(h[new], bucket_bits)])
            if lost.any():
                yield rows_of([(-1 - int(doc[lost][0] % (1 << bucket_bits)), packed(doc[lost], mark[lost], first[lost], last[lost] + length))])

    def same(group: pd.DataFrame) -> pa.RecordBatch:
        bucket, unlike = int(group["bucket"].iloc[0]), np.zeros(0, dtype=np.uint64)
        if bucket < 0:  # found within a batch
            parts = [unpacked(d, 4) for d in group["data"]]
            spans = [np.concatenate([p[k] for p in parts]) for k in range(4)]
        else:
            parts = [unpacked(d, 7) for d in group["data"]]
            h, c, *rest = (np.concatenate([p[k] for p in parts]) for k in range(7))
            spans, unlike = copies(h.view(np.uint64), c.view(np.uint64), *rest, length)
        return pa.RecordBatch.from_arrays([pa.array([packed(*merged(*spans))], pa.binary()), pa.array([unlike.tobytes()], pa.binary())], ["spans", "names"])

    alike = cut(per_group(docs.mapInArrow(hashed, "bucket long, data binary"), ["bucket"], same, "spans binary, names binary"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(b, dtype=np.uint64) for b in batch.column(0).to_pylist())])
            yield rows_of([(k, names[own].tobytes()) for k, own in by_bucket(names, bucket_bits)])

    def together(group: pd.DataFrame) -> pa.RecordBatch:
        names = b"".join(group["data"])
        return pa.RecordBatch.from_arrays([pa.array([int(group["bucket"].iloc[0])], pa.int64()), pa.array([len(names) // 8], pa.int64()), pa.array([names], pa.binary())], ["bucket", "n", "hashes"])

    gathered_names = cut(per_group(alike.select("names").mapInArrow(named, "bucket long, data binary"), ["bucket"], together, "bucket long, n long, hashes binary"))
    unlike = context.broadcast(filter_of(gathered_names, bucket_bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoded(t) for t in batch.column(2).to_pylist()]
            h, _, row, at, first, last = anchors(texts, length)
            doc, mark = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            some = unlike.value.holds(name_of(h, doc, mark, at))
            h, row, doc, mark, at, first, last = (x[some] for x in (h, row, doc, mark, at, first, last))
            pieces = [texts[r][a : b + length] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
            columns = (h.view(np.int64), doc, mark, at, first, last)
            yield rows_of([(k, packed(*(x[own] for x in columns), np.frombuffer(b"".join(pieces[i] for i in own), dtype=np.uint8))) for k, own in by_bucket(h, bucket_bits)])

    def by_document(doc: np.ndarray, mark: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        part = (doc ^ mark) % (1 << bucket_bits)
        return rows_of([(int(k), packed(doc[part == k], mark[part == k], span[part == k])) for k in np.unique(part)])

    def decide(group: pd.DataFrame) -> pa.RecordBatch:
        parts = [unpacked(d, 6) for d in group["data"]]
        return by_document(*merged(*resolve(*(np.concatenate([p[k] for p in parts]) for k in range(7)), length)))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield by_document(*unpacked(data, 3)[:3])

    def gathered(group: pd.DataFrame) -> pa.RecordBatch:
        parts = [unpacked(d, 3) for d in group["data"]]
        doc, mark, span = (np.concatenate([p[k] for p in parts]) for k in range(3))
        doc, mark, span = merged(doc, mark, span >> 32, span & 0xFFFFFFFF)
        bounds = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]), [True]])) if len(doc) else np.zeros(1, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]]), pa.array(mark[bounds[:-1]]), pa.array([span[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["_doc", "_mark", "cuts"])

    found = per_group(docs.mapInArrow(whole, "bucket long, data binary"), ["bucket"], decide, "bucket long, data binary")
    return per_group(found.union(alike.select("spans").mapInArrow(passed, "bucket long, data binary")), ["bucket"], gathered, "_doc long, _mark long, cuts binary")


def merged(doc: np.ndarray, mark: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document, the maximal ranges covered, from and to packed into one number."""
    order = np.lexsort((begin, mark, doc))
    doc, mark, begin, end = doc[order], mark[order], begin[order], end[order]
    if not len(doc):
        return doc, doc, doc
    base = np.cumsum(np.concatenate([[0], ((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])).astype(np.int64)])) << 32
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + begin[1:] > reach[:-1]])
    stop = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], mark[new], (begin[new] << 32) | (reach[stop] & 0xFFFFFFFF)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, _doc, _mark, text): ``_doc`` orders the rows as doc_id does, a null last."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_mark")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), mark, "text")
    ids = docs.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.asc_nulls_last("_id"))
    ids = cut(ids.withColumn("_doc", F.monotonically_increasing_id()))  # rises with the order, whatever the partitions
    return docs.select("doc_id", mark, "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "_doc", "_mark", "text")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, kept binary, starts, ends) of every row: the bytes that stay and the removed runs."""
    spark = prepare(docs.sparkSession)
    slim = placed(docs.select("doc_id", "text"))
    bucket_bits = max(4, (4 * partitions(spark) - 1).bit_length())
    cuts = removals(slim.select("_doc", "_mark", "text"), length, bucket_bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = encoded(text)
                whole = np.frombuffer(spans or b"", dtype=np.int64)
                begin, end = (whole >> 32).tolist(), (whole & 0xFFFFFFFF).tolist()
                edges = [0, *(x for pair in zip(begin, end, strict=True) for x in pair), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), kept, begin, end))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "kept", "starts", "ends"])

    kind = dict(docs.dtypes)["doc_id"]
    return slim.join(cuts, ["_doc", "_mark"], "left").select("doc_id", "text", "cuts").mapInArrow(each, f"doc_id {kind}, n_bytes long, kept binary, starts array<long>, ends array<long>")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sizes of what was removed, the number of removed runs and the hash of what stays, for every row."""
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return deduplicate(docs, length).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
