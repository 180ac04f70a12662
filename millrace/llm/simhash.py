"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint holds, bit by bit, the majority over the hashes of a text's word shingles. Its bits form a ring
of segments. If two fingerprints differ in at most ``tau`` bits, some chain of consecutive segments starts at
which the first l segments differ in at most l * tau / m bits together, for every l (the pigeonring
principle). With m > tau the first segment of that chain is equal and the first two differ in one bit at most:
these two make the join keys, the rest of the chain prunes inside a bucket, and the full Hamming distance is
taken last.

Defined cases: a null text has no words; without words the fingerprint is zero, which links like any other;
fewer words than a shingle make one shingle; repeated shingles count each time; repeated rows and ids are kept;
a row with a null id links like any other but names no component, so a component of null ids alone is null; ids
may be strings; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from millrace.llm.common import BROADCAST_ROWS, connected_components, crowded, cut, pairs_within, partitions, per_group, prepare, spanning, whole_groups, without

#: Rows of hashes that are counted at a time, which bounds memory for a text of any length.
ROWS = 8192
#: Members of a bucket that meet in one task at most.
BLOCK = 2048
#: Segments of a wide fingerprint's chain whose budgets are checked before the whole distance.
CHAIN = 8


def words(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, A-Z only, cut at the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included, in order."""
    parts = words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - size + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(size, len(parts)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)


def widen(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """(n, n_words) independent 64-bit words from each hash; the first is the hash itself."""
    if n_words == 1:
        return hashes[:, None]
    z = hashes[:, None] + np.arange(n_words, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = hashes
    return z


def bits(rows: np.ndarray) -> np.ndarray:
    """(n, w) words to (n, 64 w) bits, the highest bit of each word first."""
    return np.unpackbits(np.ascontiguousarray(rows).astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows set each bit. Wide rows are added bit-sliced, three at a time, as full adders do."""
    if rows.shape[1] < 4 or len(rows) < 8:
        return bits(rows).sum(axis=0, dtype=np.int64)
    total, weight, now = 0, 1, rows
    while True:
        carry = []
        while len(now) > 2:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            x = a ^ b
            carry.append((a & b) | (x & c))
            now = np.concatenate([x ^ c, now[3 * third :]])
        if len(now) == 2:
            carry.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        total = total + bits(now)[0].astype(np.int64) * weight
        if not carry:
            return total
        now, weight = np.concatenate(carry), 2 * weight


def fingerprint(text: str | None, size: int = 4, n_words: int = 1) -> bytes:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return bytes(8 * n_words)
    return majority(hashes, n_words)


def majority(hashes: np.ndarray, n_words: int) -> bytes:
    counts = sum(bit_counts(widen(hashes[at : at + ROWS], n_words)) for at in range(0, len(hashes), ROWS))
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, size: int = 4, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary) for every row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, size, n_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "fp"])

    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, fp binary")


def matrix(prints: pd.Series) -> np.ndarray:
    """(n, w) words of binary fingerprints."""
    return np.frombuffer(b"".join(prints), dtype=">u8").astype(np.uint64).reshape(len(prints), -1)


def edges_of_ring(width: int, m: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of m segments as even as can be."""
    at = [round(i * width / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def chain_keys(prints: pd.Series, m: int, masked: bool) -> np.ndarray:
    """(n, k) join keys: segment i, and if ``masked`` its successor with one bit left out, for every i and bit."""
    flat = bits(matrix(prints)).astype(np.int64)
    ring = edges_of_ring(flat.shape[1], m)
    value = [flat[:, a : a + w] @ (1 << np.arange(w, dtype=np.int64)) for a, w in ring]
    keys = []
    for i in range(m):
        if not masked:
            keys.append((np.int64(i) << 48) | value[i])
            continue
        after, (_, w) = value[(i + 1) % m], ring[(i + 1) % m]
        for j in range(w):
            keys.append((np.int64(i) << 48) | (np.int64(j) << 40) | (value[i] << 16) | (after & ~np.int64(1 << j)))
    return np.stack(keys, axis=1)


def links(prints: DataFrame, tau: int, m: int, masked: bool = True, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever fingerprints differing in ``tau`` bits at most connect.

    ``prints`` is (id long, fp) with one id for each distinct fingerprint. A group of n linked members yields about
    n links, not all pairs. ``masked`` with m > tau loses no pair. Without it, for wide fingerprints, a pair is a
    candidate if a segment is equal and the chain of ``CHAIN`` segments from there on keeps its budgets; pairs
    whose chain starts at an unequal segment are lost, so such links only propose.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                frame = batch.to_pandas()
                keys = chain_keys(frame["fp"], m, masked)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(frame["id"].to_numpy(), keys.shape[1]))], ["key", "id"])

    def work(group: pd.DataFrame) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        group = group.sort_values("id")  # links lead to the smallest id, so that many buckets find the same ones
        fps, ids = matrix(group["fp"]), group["id"].to_numpy()
        start = int(group["key"].iloc[0]) >> 48
        masks, parts = ring_masks(fps.shape[1] * 64, m), ring_words(fps.shape[1] * 64, m)

        def near(i: int, left: np.ndarray) -> np.ndarray:
            alive, so_far = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
            for step in range(1, 1 + (m if masked else min(m, CHAIN))):  # the chain's budgets
                k = (start + step - 1) % m
                x = fps[left[alive], parts[k]] ^ fps[i, parts[k]]
                so_far = so_far + np.bitwise_count(x & masks[k, parts[k]]).sum(axis=1, dtype=np.int64)
                ok = so_far * m <= step * tau
                alive, so_far = alive[ok], so_far[ok]
                if not len(alive):
                    break
            whole = np.bitwise_count(fps[left[alive]] ^ fps[i]).sum(axis=1, dtype=np.int64) <= tau
            ok = np.zeros(len(left), dtype=bool)
            ok[alive[whole]] = True
            return ok

        found = spanning(len(ids), near)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"]) if found else None

    spread = prints.repartition(partitions(prints.sparkSession), "id")  # each row becomes many
    buckets = crowded(spread.mapInArrow(emit, "key long, id long"), "key", "id", block)
    return per_group(buckets.join(prints, "id").select("key", "_a", "_b", "id", "fp"), ["key", "_a", "_b"], work, "a long, b long")


@cache
def ring_masks(width: int, m: int) -> np.ndarray:
    """(m, w) words with the bits of each segment set."""
    flat = np.zeros((m, width), dtype=np.uint8)
    for i, (a, w) in enumerate(edges_of_ring(width, m)):
        flat[i, a : a + w] = 1
    return np.packbits(flat, axis=1).view(">u8").astype(np.uint64)


@cache
def ring_words(width: int, m: int) -> list[slice]:
    """The words of a fingerprint that each segment lies in."""
    return [slice(a // 64, (a + w + 63) // 64) for a, w in edges_of_ring(width, m)]


def components(docs: DataFrame, size: int = 4, n_words: int = 1, tau: int = 4, m: int = 5, masked: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable through linked fingerprints.

    Equal fingerprints collapse to one node before anything is compared, so copies cost one row each. Nodes have
    numbers of their own: ids may be null, which are no candidates for the smallest, or of any type with an order.
    """
    prints = cut(fingerprints(docs, size, n_words, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    joined = connected_components(links(classes.select("id", "fp"), tau, m, masked))
    placed = cut(classes.join(joined, F.col("id") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "id").alias("part")))
    roots = placed.groupBy(F.col("part").alias("root")).agg(F.min("least").alias("component"))
    return prints.join(placed.join(roots, F.col("part") == F.col("root")).select("fp", "component"), "fp").select("id", "fp", "component")


#: Wide fingerprints for shingle similarity: 16 words of 64 bits in 42 segments of 24 or 25 bits.
WIDE_WORDS, WIDE_SEGMENTS = 16, 42


def radius(similarity: float, n_words: int) -> int:
    """Expected bits that differ between fingerprints of shingle sets of this Jaccard similarity and like size."""
    cosine = 2 * similarity / (1 + similarity)
    return round(64 * n_words * float(np.arccos(cosine)) / np.pi)


#: Texts whose shingles tell which ones are common, most common shingles kept, texts of a bucket that meet in one task at most.
SAMPLE, COMMON, SETS_BLOCK = 5_000, 200_000, 2048
#: Pairs that are compared at a time.
PAIRS = 1 << 18
#: Words whose hashes a worker keeps.
CACHED_WORDS = 1 << 18
#: Bits that bound in how many shingles two sets differ.
PARITIES = 1024


def mark_of(text: Column) -> Column:
    """64 bits of hash that stand for a text; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class WordHashes(dict):
    """XXH64 of words, those seen first kept."""

    def __missing__(self, word: bytes) -> int:
        found = xxh64_intdigest(word, 42)
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


_WORDS = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, each mixed from the hashes of its words in order."""
    parts = words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), dtype=np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


class Rarity:
    """A global order of shingles: those that are not common first, by hash, then the common ones by rising frequency."""

    def __init__(self, common: np.ndarray):
        order = np.argsort(common)
        self.sorted, self.rank = common[order], (order + 1).astype(np.int32)

    def prefix(self, hashes: np.ndarray, at_least: Fraction) -> np.ndarray:
        """The first shingles of a sorted set: sets alike to ``at_least`` share one of them, in any order common to all."""
        n = len(hashes)
        most = n - math.ceil(at_least * n) + 1
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            rank = np.where(self.sorted[at] == hashes, self.rank[at], 0)
            rare = hashes[rank == 0]
            if len(rare) < most:
                known = np.flatnonzero(rank)
                hashes = np.concatenate([rare, hashes[known[np.argsort(rank[known], kind="stable")]]])
            else:
                hashes = rare
        return hashes[:most]


def alike(a: np.ndarray, b: np.ndarray, at_least: Fraction) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``at_least``."""
    if not len(a) or not len(b) or min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= at_least * (len(a) + len(b) - both)


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles of three texts or more of a sample, by rising count."""
    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("mark"), F.lit(max(1, n // SAMPLE))) == 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, counts = np.unique(np.concatenate([shingle_set(t, size) for t in batch.column(0).to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "n"])

    counts = part.select("text").mapInArrow(each, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow().column(0).to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def shared_keys(texts: DataFrame, size: int, at_least: Fraction) -> DataFrame:
    """(key, mark): prefix shingles and the texts that share one with a text of like size; one shuffle and no row for others."""
    shared = texts.sparkSession.sparkContext.broadcast(Rarity(common_shingles(texts, size)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task send their keys once
        for batch in batches:
            rows = []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if mark not in seen and len(hashes := shingle_set(text, size)):
                    seen.add(mark)
                    rows.append((shared.value.prefix(hashes, at_least), len(hashes), mark))
            if rows:
                n = [len(keys) for keys, _, _ in rows]
                columns = np.concatenate([keys for keys, _, _ in rows]).view(np.int64), np.repeat(np.array([r[1] for r in rows], dtype=np.int32), n), np.repeat(np.array([r[2] for r in rows], dtype=np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "size", "mark"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and size; the last key of a batch waits for the next."""
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]):
                last = int(np.searchsorted(held[0], held[0][-1]))
                yield several(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        yield several(*held)

    def several(keys: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
        keys, sizes, marks = keys[new], sizes[new].astype(np.int64), marks[new]
        near = (keys[1:] == keys[:-1]) & (sizes[:-1] * at_least.denominator >= sizes[1:] * at_least.numerator)
        twin = np.zeros(len(keys), dtype=bool)
        twin[1:] = near
        twin[:-1] |= near
        return pa.RecordBatch.from_arrays([pa.array(keys[twin]), pa.array(marks[twin])], ["key", "mark"])

    made = texts.select("mark", "text").mapInArrow(emit, "key long, size int, mark long")
    return made.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key", "size", "mark").mapInArrow(keep, "key long, mark long")


def parities(hashes: np.ndarray, width: int = PARITIES) -> bytes:
    """``width`` bits: whether the number of shingles in a class of hashes is odd. Two sets that differ in k shingles differ in k bits at most."""
    return np.packbits(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % width, minlength=width) & 1).tobytes()


def wide_parities(hashes: np.ndarray) -> bytes:
    """As many bits as shingles at least, a power of two; wider ones fold to narrower ones."""
    return parities(hashes, max(PARITIES, 1 << max(0, len(hashes) - 1).bit_length()))


def may_be_alike(x: bytes, y: bytes, sizes: int, most: Fraction) -> bool:
    """Whether the parities allow that at most ``most`` of the summed ``sizes`` differ."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum()) <= most * sizes


def plausible(pairs: DataFrame, classes: DataFrame, at_least: Fraction) -> DataFrame:
    """The (a, b) that wide parities do not rule out, so that few texts travel."""
    most = (1 - at_least) / (1 + at_least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_be_alike(x, y, n, most) for n, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: classes.select(F.col("id").alias(k), F.col("size").alias(f"n_{k}"), F.col("wide").alias(f"w_{k}"))
    both = pairs.distinct().join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "w_a", "w_b").mapInArrow(each, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, at_least: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` of marks whose shingle sets are alike; texts travel, which are smaller than sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None  # rows come by a
        for batch in batches:
            ok = []
            for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if a != last:
                    last, left = a, shingle_set(x, size)
                ok.append(alike(left, shingle_set(y, size), at_least))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = cut(pairs.distinct())
    needed = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    found = texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, texts["mark"] == needed["node"]).groupBy("node").agg(F.first("text").alias("text"))
    both = pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def missing_links(keyed: DataFrame, nodes: DataFrame, classes: DataFrame, at_least: Fraction) -> DataFrame:
    """(a, b): nodes of different components that share a key and that neither size nor parities tell to be unlike.

    ``nodes`` is (mark, node, component), ``classes`` has size and parity of the nodes. Sets alike to s differ in
    (1 - s) / (1 + s) of the sum of their sizes at most.
    """
    placed = cut(keyed.join(nodes, "mark").select("key", "node", F.col("component").alias("part")).distinct())
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    most = (1 - at_least) / (1 + at_least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_groups(batches, ["key", "_a", "_b"]):
            ids, part, n, odd = frame["node"].to_numpy(), frame["part"].to_numpy(), frame["size"].to_numpy(dtype=np.int64), matrix(frame["parity"])
            place = frame["_group"].to_numpy() << 40
            end = np.searchsorted(place + n, place + n * at_least.denominator // at_least.numerator, side="right")  # rows come by size
            for i, j in pairs_within(end, PAIRS):
                ok = part[i] != part[j]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) * most.denominator <= most.numerator * (n[i] + n[j])
                found = np.unique(np.stack([np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])]), axis=1)
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    buckets = crowded(placed.join(mixed, "key"), "key", "node", SETS_BLOCK)
    ready = buckets.join(classes.select(F.col("id").alias("node"), "size", "parity"), "node").select("key", "_a", "_b", "node", "part", "size", "parity")
    keys = ["key", "_a", "_b"]
    return ready.repartition(partitions(ready.sparkSession), *keys).sortWithinPartitions(*keys, "size").mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n, component): the rows of ``docs`` by id and text, how many they are, and their group.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more; groups are
    the components of these links. Equal sets collapse first. The 1024-bit fingerprints of the sets then find most
    links, each verified on the sets. What they miss, a prefix join finds: sets that are alike share one of their
    rarest shingles, and texts of different components that share one are verified unless a bound rules them out. No link is lost
    or wrong but for collisions of 64-bit hashes. Texts without words are alike.
    """
    at_least = Fraction(str(similarity))
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), mark_of(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
            prints = [majority(s, WIDE_WORDS) if len(s) else bytes(8 * WIDE_WORDS) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.binary()), pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(parities, sets)), pa.binary()), pa.array(list(map(wide_parities, sets)), pa.binary())], ["id", "mark", "fp", "digest", "size", "parity", "wide"])

    prepare(docs.sparkSession)
    prints = cut(slim.mapInArrow(each, f"id {kind}, mark long, fp binary, digest binary, size long, parity binary, wide binary"))
    classes = cut(prints.groupBy("digest").agg(F.min("mark").alias("id"), *[F.min(c).alias(c) for c in ("fp", "size", "parity", "wide")]))
    texts = slim.select("mark", "text")
    links_found = cut(verified(links(classes.select("id", "fp"), radius(similarity, WIDE_WORDS), WIDE_SEGMENTS, False), texts, size, at_least))
    marks = prints.select("mark", "digest").distinct().join(classes.select("digest", F.col("id").alias("node")), "digest").select("mark", "node")

    def grouped(edges: DataFrame) -> DataFrame:
        joined = connected_components(edges).select(F.col("node").alias("_node"), "component")
        return cut(marks.join(joined, F.col("node") == F.col("_node"), "left").select("mark", "node", F.coalesce("component", "node").alias("component")))

    keyed = cut(shared_keys(texts, size, at_least))
    more = cut(verified(plausible(missing_links(keyed, grouped(links_found), classes, at_least), classes, at_least), texts, size, at_least))
    nodes = grouped(links_found.union(more))
    return prints.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).join(nodes, "mark").select("id", "mark", "n", "component")


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: the smallest id, a null one last, then the smallest mark of the text.

    Of rows that repeat this id and text, the least in the order of all columns stays.
    """
    order = lambda: F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    rows = cut(near_duplicates(docs, size, similarity, id_col, text_col))
    best = rows.groupBy(F.col("component").alias("_component")).agg(F.min(order()).alias("best"))
    told = cut(rows.join(best, F.col("component") == F.col("_component")).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "n", F.col("best").eqNullSafe(order()).alias("_kept")))
    mark = mark_of(docs[text_col])
    matches = lambda other: docs[id_col].eqNullSafe(other["_id"]) & (mark == other["_mark"])
    bad = cut(told.where("not _kept or n > 1").select("_id", "_mark"))
    kept = without(docs, bad, matches(bad))
    again = cut(told.where("_kept and n > 1").select("_id", "_mark"))
    if again.isEmpty():
        return kept
    repeated = docs.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, matches(again)).select(docs["*"], "_id", "_mark")
    return kept.union(repeated.groupBy("_id", "_mark").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_row")).select("_row.*"))
