"""Byte-level BPE: distributed counting, merge training on the counted words, encoding and decoding.

Words travel as array<int> of token ids, ids 0..255 being bytes. Training reads every distinct pre-token. Those of
``ON_DRIVER`` bytes together are merged on the driver, which keeps pair counts incrementally with a lazy heap; more stay
in tables and are merged in rounds (``merges``), with the same result. Encoding keeps one merge cache of bounded size per Python worker over the pieces that the JVM has cut, so it needs no shuffle.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import pretokens, pretokens_keeping, utf8_bytes, without_specials
from millrace.sources.store import remove, stored

#: Bytes of different pre-tokens that are merged on the driver, some 800,000 words; more are merged where they are.
ON_DRIVER = 8_000_000
#: Pieces that a Python worker keeps encoded, and values of a list column that it holds as Python objects at a time.
CACHED, VALUES = 200_000, 1 << 18


def pretoken_counts(docs: DataFrame, specials: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """(pretoken, freq): every piece of the corpus with its number of occurrences; special tokens are dropped."""
    text = F.col(text_col)
    pieces = F.flatten(F.transform(without_specials(text, specials), pretokens)) if specials else pretokens(text)
    return docs.select(F.explode(pieces).alias("pretoken")).groupBy("pretoken").agg(F.count(F.lit(1)).alias("freq"))


def frequent(counts: DataFrame, min_freq: int | None = None, most: int | None = None) -> DataFrame:
    """Pre-tokens of ``min_freq`` or more occurrences, the ``most`` most frequent, ties by the pre-token."""
    kept = counts if min_freq is None or min_freq <= 1 else counts.where(F.col("freq") >= min_freq)
    return kept if most is None else kept.orderBy(F.desc("freq"), "pretoken").limit(most)


def as_words(counts: DataFrame) -> DataFrame:
    """(ids, freq): pre-tokens as byte ids."""
    return counts.select(utf8_bytes(F.col("pretoken")).alias("ids"), "freq")


def adjacent(ids: str) -> Column:
    """array<struct<left, right>> of neighbouring ids."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.zip_with(F.slice(ids, 1, n), F.slice(ids, 2, n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): adjacent ids, every occurrence weighted by the word's frequency."""
    return words.select(F.explode(adjacent("ids")).alias("p"), "freq").groupBy("p.left", "p.right").agg(F.sum("freq").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The pair with the largest (n, left, right)."""
    return counts.agg(F.max(F.struct("n", "left", "right")).alias("b")).where("b is not null").select("b.left", "b.right", "b.n")


def inverted_index(words: DataFrame) -> DataFrame:
    """(left, right, word_id): a row for each pair and word that holds it, from (word_id, ids); a frequent pair is many rows."""
    return words.select("word_id", F.explode(F.array_distinct(adjacent("ids"))).alias("p")).select("p.left", "p.right", "word_id")


def train_merges(words: list[tuple[Sequence[int], int]], n_merges: int, tie: str = "id", first_id: int = 256) -> list[tuple[int, int, int]]:
    """(left, right, n) of each merge in order. Ties go to the larger ids, or with tie="bytes" to the larger bytes."""
    tokens: dict[int, bytes] = {i: bytes([i]) for i in range(256)}
    counts: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    texts = [ids for ids, _ in words]
    for k, (ids, freq) in enumerate(words):
        for pair in zip(ids, ids[1:], strict=False):
            counts[pair] += freq
            where[pair].append(k)

    def rank(pair: tuple[int, int]) -> tuple:
        if tie == "id":
            return (-counts[pair], -pair[0], -pair[1])
        return (-counts[pair], _Reversed(tokens[pair[0]]), _Reversed(tokens[pair[1]]))

    heap = [(rank(p), p) for p in counts]
    heapq.heapify(heap)
    merges = []
    while len(merges) < n_merges and heap:
        key, pair = heapq.heappop(heap)
        if counts.get(pair, 0) <= 0:
            continue
        if -key[0] != counts[pair]:  # counted anew since it was pushed
            heapq.heappush(heap, (rank(pair), pair))
            continue
        new = first_id + len(merges)
        tokens[new] = tokens[pair[0]] + tokens[pair[1]]
        merges.append((*pair, counts[pair]))
        touched = set()
        for k in dict.fromkeys(where.pop(pair)):
            old, freq = texts[k], words[k][1]
            merged = merge_pair(old, pair, new)
            if len(merged) == len(old):
                continue
            for p in zip(old, old[1:], strict=False):
                counts[p] -= freq
                touched.add(p)
            for p in zip(merged, merged[1:], strict=False):
                counts[p] += freq
                where[p].append(k)
                touched.add(p)
            texts[k] = merged
        for p in touched:
            if counts[p] > 0:
                heapq.heappush(heap, (rank(p), p))
    return merges


class _Reversed:
    """Orders byte strings from large to small."""

    __slots__ = ("value",)

    def __init__(self, value: bytes):
        self.value = value

    def __lt__(self, other: _Reversed) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and self.value == other.value


def merge_pair(ids: Sequence[int], pair: tuple[int, int], new: int) -> list[int]:
    """Every occurrence of ``pair`` replaced, from left to right."""
    out, i, n = [], 0, len(ids)
    while i < n:
        if i + 1 < n and ids[i] == pair[0] and ids[i + 1] == pair[1]:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def train(docs: DataFrame, vocab_size: int, specials: Sequence[str] = (), min_freq: int | None = None, most: int | None = None, tie: str = "id", text_col: str = "text", folder: str | None = None) -> list[tuple[int, int, int]]:
    """Merges of a vocabulary of ``vocab_size`` tokens: 256 bytes, the merges, the special tokens.

    All pre-tokens count unless ``min_freq`` or ``most`` is given. ``folder`` is a new one that all executors share: with it and
    ties by id, pre-tokens of more than ``ON_DRIVER`` bytes are merged in rounds over tables. Without it all come to the driver.
    """
    counts, n_merges = frequent(pretoken_counts(docs, specials, text_col), min_freq, most), max(0, vocab_size - 256 - len(specials))
    if folder is None or tie != "id":
        return train_merges(_on_driver(counts), n_merges, tie)
    from millrace.operators.merges import train_rounds  # it is built on this module

    counts = stored(counts, f"{folder}/pretokens")
    if (counts.agg(F.sum(F.octet_length("pretoken"))).first()[0] or 0) > ON_DRIVER:
        found = train_rounds(as_words(counts), n_merges, folder)
    else:
        found = train_merges(_on_driver(counts), n_merges)
    remove(docs.sparkSession, f"{folder}/pretokens")
    return found


def _on_driver(counts: DataFrame) -> list[tuple[bytes, int]]:
    table = counts.toArrow()
    return [(w.encode(), n) for w, n in zip(table.column("pretoken").to_pylist(), table.column("freq").to_pylist(), strict=True)]


def vocabulary(merges: Sequence[tuple[int, ...]], specials: Sequence[str] = ()) -> list[bytes]:
    """Token bytes by id: bytes, merges, then the special tokens that are not there yet."""
    tokens = [bytes([i]) for i in range(256)]
    for left, right, *_ in merges:
        tokens.append(tokens[left] + tokens[right])
    for s in specials:
        if s.encode() not in tokens:
            tokens.append(s.encode())
    return tokens


class Encoder:
    """Merges, lowest rank first, to a fixed point. Tokens with equal bytes stand for the last of them."""

    def __init__(self, tokens: Sequence[bytes], merges: Sequence[tuple[int, ...]], specials: Sequence[str] = ()):
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.ranks = {}
        for rank, (left, right, *_) in enumerate(merges):
            pair = (self.ids[tokens[left]], self.ids[tokens[right]])
            self.ranks[pair] = (rank, self.ids[tokens[left] + tokens[right]], pair)
        self.byte = {t[0]: i for t, i in self.ids.items() if len(t) == 1}
        self.special = {s: self.ids[s.encode()] for s in specials}
        self.cache: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(self.cache) < CACHED:
                self.cache[piece] = found
        return found

    def merged(self, piece: str) -> list[int]:
        """The ids of a piece, not kept."""
        if piece in self.special:
            return [self.special[piece]]
        found = [self.byte[b] for b in piece.encode()]
        while known := [r for r in map(self.ranks.get, zip(found, found[1:], strict=False)) if r]:
            _, new, pair = min(known)
            found = merge_pair(found, pair, new)
        return found


def some_rows(lists: pa.ListArray, most: int = VALUES) -> Iterator[tuple[pa.Array, list[int]]]:
    """(values, where the rows end) of consecutive rows of a list array without nulls that hold ``most`` values together, or of one row."""
    offsets, a = lists.offsets.to_numpy(), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield lists.values.slice(int(offsets[a]), int(offsets[b] - offsets[a])), (offsets[a : b + 1] - offsets[a]).tolist()
        a = b


def _cut(docs: DataFrame, encoder: Encoder, text: Column | None) -> Column:
    pieces = pretokens_keeping(F.col("text") if text is None else text, list(encoder.special))
    return F.coalesce(pieces, F.array().cast("array<string>"))


def encode(docs: DataFrame, encoder: Encoder, text: Column | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with array<int> ``out``, the tokens of ``text``; a null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    @F.arrow_udf("array<int>")
    def ids_of(lists: pa.Array) -> pa.Array:
        packed, rows = _packed_cache(shared.value), []
        for values, bounds in some_rows(lists):
            flat = values.to_pylist()
            rows += [b"".join(map(packed.__getitem__, flat[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))

    return docs.withColumn(out, ids_of(_cut(docs, encoder, text)))


def token_counts(docs: DataFrame, encoder: Encoder, text: Column | None = None) -> DataFrame:
    """(id, n): how often each id occurs in the encoded texts. A task counts where it encodes, so no token becomes a row."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, n = _packed_cache(shared.value), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for values, _ in some_rows(batch.column(0)):
                found = np.bincount(np.frombuffer(b"".join(map(packed.__getitem__, values.to_pylist())), dtype=np.int32), minlength=len(n))
                found[: len(n)] += n
                n = found
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n[ids], pa.int64())], ["id", "n"])

    parts = docs.select(_cut(docs, encoder, text).alias("pieces")).mapInArrow(counted, "id int, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def byte_ids(text: Column) -> Column:
    """array<int> of the UTF-8 bytes of each text, for whole corpora: the text's buffer itself, widened. Null stays null."""

    @F.arrow_udf("array<int>")
    def widened(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(b for b in whole.to_pylist() if b), dtype=np.uint8).astype(np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.append(whole.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(data))

    return widened(text)


class _Packed(dict):
    """Token ids of a piece as packed 32-bit numbers, computed once."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = np.asarray(self.encoder.merged(piece), dtype=np.int32).tobytes()
        if len(self) < CACHED:
            self[piece] = found
        return found


_PACKED: list[_Packed] = []


def _packed_cache(encoder: Encoder) -> _Packed:
    """The worker's cache for this encoder; it outlives a batch."""
    if not _PACKED or _PACKED[0].encoder is not encoder:
        _PACKED[:] = [_Packed(encoder)]
    return _PACKED[0]


def decode(docs: DataFrame, tokens: Sequence[bytes], ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of array<int> ``ids_col``; invalid UTF-8 becomes U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(list(tokens))

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        token, texts = shared.value.__getitem__, []
        for values, bounds in some_rows(lists):
            flat = values.to_numpy(zero_copy_only=False).tolist()
            texts += [b"".join(map(token, flat[a:b])).decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.array(texts, pa.string())

    return docs.withColumn(out, text_of(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def as_array(ids: Sequence[int], vocab_size: int) -> np.ndarray:
    """Token ids in the smallest unsigned type that holds the vocabulary."""
    return np.asarray(ids, dtype=np.uint16 if vocab_size <= 65_535 else np.uint32)
