"""Merge training for more words than one machine holds: rounds over a table of words and a table of pair counts.

A round takes the most frequent pairs in order, as long as no two of them can meet in a word: (a, b) and (c, d) meet only where
b = c or d = a. Merging one of them leaves the counts of the others as they are, and the pairs that it makes are at most as
frequent as a pair that meets it. So all pairs above the first that meets an earlier one are merged at once, with the result
that one merge at a time has. One pass over the words, without a shuffle, merges them; the words that changed give differences
of pair counts, which are summed before they are shuffled and added to the table.

The driver sees ``WIDE`` pairs a round and the merges. Both tables are written each round and the ones before removed, so a lost
executor costs a task, not the rounds before. A lookup in a pair-to-word index in place of the pass would have to find its
rows in a table that is longer than the words themselves; ``bpe.inverted_index`` is that table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.bpe import adjacent, as_words, frequent, pair_counts, pretoken_counts
from millrace.sources.store import remove, stored

#: Pairs that a round looks at.
WIDE = 64

Pair = tuple[int, int, int]


def independent(ranked: Sequence[Pair], whole: bool) -> list[Pair]:
    """The first pairs (left, right, n) of a ranking that may be merged at once; ``whole`` if nothing follows the ranking.

    A pair of equal ids meets itself, so nothing is merged beside it that is ranked below it.
    """
    chosen: list[Pair] = []
    least = 0
    for left, right, n in ranked:
        if any(left == r or right == l for l, r, _ in chosen):
            least = n
            break
        chosen.append((left, right, n))
        if left == right:
            least = n
            break
    else:
        least = 0 if whole else ranked[-1][2]
    return chosen[:1] + [p for p in chosen[1:] if p[2] > least]


def merge_many(flat: np.ndarray, ends: np.ndarray, pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, ends, changed) of words laid end to end, every occurrence of ``pairs`` replaced from left to right."""
    word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    keys = np.array([(l << 32) | r for l, r in pairs], dtype=np.int64)
    order, ids = np.argsort(keys), np.array(list(pairs.values()), dtype=flat.dtype)
    own = (flat[:-1].astype(np.int64) << 32) | flat[1:]
    at = np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)
    hit = np.flatnonzero((keys[order][at] == own) & (word[:-1] == word[1:]))
    first = np.diff(hit, prepend=-2) != 1  # hits side by side are a run of one id: every second one counts
    run = np.flatnonzero(first)
    hit = hit[(np.arange(len(hit)) - run[np.cumsum(first) - 1]) % 2 == 0] if len(hit) else hit
    out = flat.copy()
    out[hit] = ids[order][at[hit]]
    gone = np.bincount(word[hit], minlength=len(ends))
    return np.delete(out, hit + 1), ends - np.cumsum(gone), gone > 0


def merged(words: DataFrame, pairs: dict[tuple[int, int], int]) -> DataFrame:
    """(ids, freq, before) of ``words`` (ids, freq) that still have a pair or had one; ``before`` holds the ids of a changed word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            if not len(ends):
                continue
            flat, until, changed = merge_many(lists.flatten().to_numpy(), ends, pairs)
            now = pa.ListArray.from_arrays(pa.array([0, *until], pa.int32()), pa.array(flat, pa.int32()))
            before = pa.compute.if_else(pa.array(changed), lists, pa.nulls(len(lists), lists.type))
            keep = pa.array(changed | (np.diff(until, prepend=0) > 1))
            yield pa.RecordBatch.from_arrays([now, batch.column(1), before], ["ids", "freq", "before"]).filter(keep)

    return words.select("ids", "freq").mapInArrow(each, "ids array<int>, freq long, before array<int>")


def differences(words: DataFrame) -> DataFrame:
    """(left, right, n): what the changed words add to the counts of pairs and take from them."""
    both = F.array(F.struct(F.col("before").alias("ids"), (-F.col("freq")).alias("freq")), F.struct("ids", "freq"))
    each = words.where("before is not null").select(F.inline(both)).select(F.explode(adjacent("ids")).alias("p"), "freq")
    return each.select("p.left", "p.right", F.col("freq").alias("n"))


def train_rounds(words: DataFrame, n_merges: int, folder: str, first_id: int = 256) -> list[Pair]:
    """(left, right, n) of each merge in order, ties to the larger ids: what ``bpe.train_merges`` finds, from ``words`` (ids, freq).

    ``folder`` is a new one that all executors share.
    """
    spark, merges, number = words.sparkSession, [], 0
    now = stored(words.select("ids", F.col("freq").cast("long").alias("freq"), F.lit(None).cast("array<int>").alias("before")), f"{folder}/words-0")
    counts = stored(pair_counts(now), f"{folder}/pairs-0")
    while len(merges) < n_merges:
        ranked = [tuple(r) for r in counts.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(WIDE + 1).collect()]
        if not ranked:
            break
        chosen = independent(ranked, len(ranked) <= WIDE)[: n_merges - len(merges)]
        new = {(left, right): first_id + len(merges) + k for k, (left, right, _) in enumerate(chosen)}
        merges += chosen
        number += 1
        now = stored(merged(now, new), f"{folder}/words-{number}")
        counts = stored(counts.union(differences(now)).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), f"{folder}/pairs-{number}")
        remove(spark, f"{folder}/words-{number - 1}")
        remove(spark, f"{folder}/pairs-{number - 1}")
    return merges


def train(docs: DataFrame, vocab_size: int, folder: str, specials: Sequence[str] = (), min_freq: int | None = None, most: int | None = None, text_col: str = "text") -> list[Pair]:
    """As ``bpe.train`` with ties by id, but no pre-token leaves the executors, and no number of them is too large."""
    counts = frequent(pretoken_counts(docs, specials, text_col), min_freq, most)
    return train_rounds(as_words(counts), max(0, vocab_size - 256 - len(specials)), folder)
