"""Variable-capacity best-fit packing.

Items go in falling length into the open bin that they fill most; where none has room, the bin size with the
least cost per token of that length is opened; in the end each bin shrinks to the smallest permitted size that
holds its contents. Items of one length are alike, so the plan is made on the driver from the counts by length,
at most one per token of the largest size, whatever the number of documents. It moves whole ranges of equally
filled bins at once and equals item-by-item best fit. Each item then finds its bin from its rank among the items
of its length.

Defined cases: a document longer than the largest size is cut into pieces of that size and a rest; one without
tokens, or with a null text, keeps a row with n_tokens 0 and no bin; repeated rows are packed once each; a null id is packed
like any other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, prepare

SIZES = (512, 1024, 2048, 4096)
#: Cost of a bin of c tokens: OVERHEAD + c + c * c / ATTENTION.
OVERHEAD, ATTENTION = 64.0, 65536.0
#: Salts by which items of one length are ranked apart, at least, and items of the most frequent length to a salt.
SALTS, SALT_ROWS = 64, 1 << 20


def cost(size: int) -> float:
    return OVERHEAD + size + size * size / ATTENTION


def opening(length: int, sizes: Sequence[int]) -> int:
    """The permitted size with the least cost per token if filled with items of this length; ties: the smaller."""
    return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / (s // length * length), s))


@dataclass
class Plan:
    """entries: (length, first rank, first bin, items a bin, offset), bins: (first bin, count, fill, final size)."""

    entries: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], sizes: Sequence[int] = SIZES) -> Plan:
    """Best fit, longest items first, over ``counts`` items by length."""
    out, next_bin = Plan(), 0
    rooms: list[int] = []  # sorted free space of open bins
    groups: dict[int, list[tuple[int, int, int]]] = {}  # by free space: heap of (first bin, count, size)

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        heapq.heappush(groups[room], group)

    def fill(length: int, rank: int, n: int, room: int, group: tuple[int, int, int]) -> int:
        """Put up to ``n`` items into the bins of ``group``; the number that went in."""
        first, count, size = group
        each = room // length
        full, rest = min(count, n // each), 0
        if full < count and n - full * each > 0:
            rest = n - full * each
        if full:
            out.entries.append((length, rank, first, each, size - room))
            put(room - each * length, (first, full, size))
        if rest:
            out.entries.append((length, rank + full * each, first + full, rest, size - room))
            put(room - rest * length, (first + full, 1, size))
        if full + bool(rest) < count:
            put(room, (first + full + bool(rest), count - full - bool(rest), size))
        return full * each + rest

    for length in sorted((k for k in counts if k > 0), reverse=True):
        n, rank = counts[length], 0
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room = opening(length, sizes)
                group = (next_bin, -(-n // (room // length)), room)
                next_bin += group[1]
            done = fill(length, rank, n, room, group)
            n, rank = n - done, rank + done
    for room, heap in groups.items():
        for first, count, size in heap:
            out.bins.append((first, count, size - room, min(s for s in sizes if s >= size - room)))
    out.bins.sort()
    return out


def token_count(text: Column) -> Column:
    """Words between the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def pack(items: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, bin_size, bin_offset) for ``items`` (doc_id, n_tokens).

    The plan and its bins are broadcast: a few entries for each length up to the largest size.
    """
    spark = prepare(items.sparkSession)
    sizes = tuple(sorted(sizes))
    largest = sizes[-1]
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    pieces = items.select("doc_id", n.alias("all")).select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / largest), F.lit(1)).cast("int") - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * F.lit(largest)).cast("long").alias("first_token"), F.least(F.lit(largest), F.col("all") - F.col("piece") * F.lit(largest)).cast("long").alias("n_tokens"))
    by_length = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(SALTS, -(-max(by_length.values(), default=0) // SALT_ROWS))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    made = plan(by_length, sizes)
    before = counts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("row", F.row_number().over(order) - 1).join(before, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "first_token", "n_tokens", (F.col("row") + F.col("base")).alias("rank"))

    entries = np.array(sorted(made.entries), dtype=np.int64).reshape(-1, 5)
    bins = np.array(made.bins, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((entries, bins))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, bins = shared.value
        keys = entries[:, 0] * (1 << 44) + entries[:, 1]
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            some = lengths > 0
            if not some.any():
                none = pa.nulls(batch.num_rows, pa.int64())
                columns = [none, none, none]
            else:
                at = np.maximum(np.searchsorted(keys, lengths * (1 << 44) + ranks, side="right") - 1, 0)
                _, first_rank, first_bin, each, offset = entries[at].T
                k = ranks - first_rank
                each = np.maximum(each, 1)
                bin_id = first_bin + k // each
                size = bins[np.maximum(np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 0), 3]
                columns = [pa.array(v, pa.int64(), mask=~some) for v in (bin_id, size, offset + k % each * lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_size", "bin_offset"])

    return ranked.mapInArrow(place, f"doc_id {dict(items.dtypes)['doc_id']}, piece int, first_token long, n_tokens long, bin_id long, bin_size long, bin_offset long")


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """The texts are read once: lengths are cut off before they are counted, ranked and placed."""
    return pack(cut(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"))), sizes)
