"""Language identification with language-bitmask n-gram filters.

The character 4-grams that occur in two training documents or more of a language go into a bit-sliced Bloom filter: slice l,
bit l of every row, is language l's filter, and the rows that an n-gram hashes to, and-ed, give all languages that contain it.
Over a text, popcounts per language, less the false positives that the filter's fill predicts, decide. Rows are 64 bits wide at
most; every 64 languages have a table of their own. A table has ``LEAST_ROWS`` rows, or as many as keep the fullest slice of
all tables below a quarter, so it grows with the n-grams of the bounded sample alone.

Defined cases: ``und`` and score 0 if the text is null or has no letter; a text without any known n-gram, and
any tie, goes to the language with the most training documents, then the first name; empty tables give empty
results; without any training document every text is ``und``; a row with a null id is never learned from and counts as not
held out; very long texts are taken whole; repeated rows give a row each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, prepare
from millrace.operators.instruct import first_per_group

GRAM = 4
#: Rows of a filter at least (a power of two), hash functions, rows for each n-gram of the language that has most.
LEAST_ROWS, HASHES, SPARE = 1 << 20, 2, 8
#: The classifier is fitted on at most so many documents of each language, those with the smallest id hashes.
FIT_DOCS = 2_000
#: Languages of one table: the bits of a row.
WIDE = 64
#: Code points that are handled at a time.
CHUNK = 1 << 20

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def grams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of the 4-grams over lower-cased letters, words joined and surrounded by single spaces."""
    tail = np.array([32], dtype=np.uint32)
    for at in range(0, len(text or ""), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = letters()[points]
        points = np.where(letter, points, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= tail[-1] != 32
        points = np.concatenate([tail, points[keep]])
        if at + CHUNK >= len(text) and points[-1] != 32:
            points = np.append(points, np.uint32(32))
        if len(points) >= GRAM:
            p = points.astype(np.uint64)
            n = len(p) - GRAM + 1
            h = p[:n].copy()
            for i in range(1, GRAM):
                h = h * np.uint64(0x100000001B3) + p[i : i + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            yield h ^ (h >> np.uint64(29))
        tail = points[-(GRAM - 1) :]


def rows_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The rows of each n-gram in a filter of 2 ** bits rows, one array for each hash function."""
    return [((h >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


class BitSlicedFilter:
    """Bloom filters of several languages side by side."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.bits = (max(LEAST_ROWS, SPARE * max((len(m) for m in members), default=0)) - 1).bit_length()
        self.tables, false_rate = [], []
        for first in range(0, len(languages), WIDE):
            own = members[first : first + WIDE]
            kind = np.uint8 if len(own) <= 8 else np.uint16 if len(own) <= 16 else np.uint64
            table = np.zeros(1 << self.bits, dtype=kind)
            for bit, hashes in enumerate(own):
                for at in rows_of(hashes, self.bits):
                    table[at] |= kind(1 << bit)
            self.tables.append(table)
            false_rate += [(np.count_nonzero(table & kind(1 << bit)) / len(table)) ** HASHES for bit in range(len(own))]
        self.false_rate = np.array(false_rate)

    def popcounts(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language seems to contain."""
        rows, out = rows_of(h, self.bits), []
        for k, table in enumerate(self.tables):
            mask = table[rows[0]]
            for at in rows[1:]:
                mask = mask & table[at]
            n = min(WIDE, len(self.languages) - k * WIDE)
            if table.dtype == np.uint64:
                out.append(np.array([np.count_nonzero(mask & np.uint64(1 << b)) for b in range(n)]))
            else:
                found = np.bincount(mask, minlength=1)
                out.append(found @ ((np.arange(len(found))[:, None] >> np.arange(n)) & 1))
        return np.concatenate(out)

    def decide(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        counts, n = np.zeros(len(self.languages)), 0
        for h in grams(text):
            counts += self.popcounts(h)
            n += len(h)
        real = np.maximum(counts - n * self.false_rate, 0) / (1 - self.false_rate)
        best = int(np.argmax(real))  # the languages come by falling number of documents
        total = float(real.sum())
        return self.languages[best], float(real[best]) / total if total > 0 else 0.0


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> BitSlicedFilter:
    """A filter learned from the rows where ``train`` holds and the language is known.

    At most ``fit_docs`` documents of each language are read; which ones depends on a hash of their ids alone,
    chosen before any text is read.
    """
    prepare(docs.sparkSession)
    slim = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    sizes = sorted(((r["n"], r["lang"]) for r in slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (-r[0], r[1]))
    languages = [lang for _, lang in sizes]
    chosen = first_per_group(slim, "lang", fit_docs, F.xxhash64("id"), F.col("id")).select("id", "lang").distinct()
    texts = docs.where(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    few = fit_docs * len(languages) <= BROADCAST_ROWS  # ids at most
    texts = texts.join(F.broadcast(chosen) if few else chosen, ["id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                parts = list(grams(text))
                if parts:
                    h = np.unique(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], ["lang", "gram"])

    counts = texts.select("text", "lang").mapInArrow(count, "lang string, gram long").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    table = counts.select("lang", "gram").toArrow().to_pandas()  # of the bounded sample
    own = dict(tuple(table.groupby("lang")["gram"]))
    return BitSlicedFilter(languages, [own[lang].to_numpy(dtype=np.int64).view(np.uint64) if lang in own else np.zeros(0, dtype=np.uint64) for lang in languages])


def identify(docs: DataFrame, model: BitSlicedFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The filter is broadcast: rows of 1 to 8 bytes, 8 MB for 64 languages of 130,000 n-grams or fewer."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, lang_pred string, score double")
