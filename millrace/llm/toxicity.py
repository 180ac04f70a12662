"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w . x - theta_j): one weight vector for all ordered thresholds. Features are the presence
of the words that tell toxic from other labelled documents. Grades: 0 for documents labelled not toxic; those
labelled toxic are graded 1, 2 and 3 by how many of these words they hold, cut at the terciles: the labels know no
grades, so these are derived. Weights are fitted at or above zero and scored as fitted. A document is
rejected if P(grade > 0) is above one half.

Defined cases: a null or empty text has no features and gets the intercepts' grade; without labels of both kinds
nothing is rejected and all severities are 0; a null label or a label without a document is ignored; repeated
label rows count once each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

GRADES = 4
#: The model is fitted on at most so many labelled documents, those with the smallest id hashes.
FIT_DOCS = 20_000
#: Most words that become features, the least share of toxic documents that hold a feature, and the least
#: ratio of its share among toxic documents to that among the others.
FEATURES, LEAST_SHARE, LEAST_LIFT = 512, 0.02, 4.0
#: Chance that any word becomes a feature by accident, if documents were labelled at random.
CHANCE = 0.05
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Weights by word and the ordered thresholds; no threshold means that nothing could be learned."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def beyond(self, text: str | None) -> list[float]:
        """P(grade > j) for j = 0, 1, ..."""
        known = self.weights
        eta = sum(known[w] for w in sorted(words(text) & known.keys()))
        return [float(1 / (1 + np.exp(-np.clip(eta - t, -500, 500)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 600, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of grades ``y``, by Adam on all rows.

    Equal rows are taken together. With ``positive`` no weight may fall below zero.

    theta_j = theta_0 + the exponentials of free gaps, which keeps the thresholds ordered.
    """
    total = len(x)
    rows, often = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y, often = rows[:, :-1], rows[:, -1].astype(int), often / often.sum()
    n, d = x.shape
    k = int(y.max())
    w = np.zeros(d)
    shares = np.array([np.clip(often[y > j].sum(), 1e-6, 1 - 1e-6) for j in range(k)])
    theta = np.maximum.accumulate(-np.log(shares / (1 - shares)) + np.arange(k) * 1e-3)
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros(d + k), np.zeros(d + k)
    low, high = np.maximum(y - 1, 0), np.minimum(y, k - 1)
    for step in range(1, steps + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        eta = x @ w
        above = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -60, 60)))
        p_low = np.where(y > 0, above[np.arange(n), low], 1.0)
        p_high = np.where(y < k, above[np.arange(n), high], 0.0)
        p = np.maximum(p_low - p_high, 1e-12)
        g_low, g_high = p_low * (1 - p_low) / p, p_high * (1 - p_high) / p
        grad_w = -(x.T @ ((g_low - g_high) * often)) + l2 * w / total
        grad_theta = np.zeros(k)
        np.add.at(grad_theta, low, np.where(y > 0, g_low, 0) * often)
        np.add.at(grad_theta, high, np.where(y < k, -g_high, 0) * often)
        grad_free = np.concatenate([[grad_theta.sum()], [grad_theta[j:].sum() * np.exp(free[j]) for j in range(1, k)]])
        g = np.concatenate([grad_w, grad_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[:d], free - move[d:]
        if positive:
            w = np.maximum(w, 0)
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> OrdinalModel:
    """A model of (doc_id, text) labelled by (doc_id, toxic), on at most ``fit_docs`` labelled documents.

    Copies would count a word once for each copy: documents whose rarest shingles agree count as one.
    """
    prepare(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_docs ids

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.simhash import shingle_hashes

        for batch in batches:
            texts = batch.column(0).to_pylist()
            held = [sorted(words(t)) for t in texts]
            least = [int(h.min().astype(np.int64)) if len(h := shingle_hashes(t, 5)) else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), batch.column(1), pa.array(held, pa.list_(pa.string()))], ["least", "toxic", "words"])

    sample = rows.select("text", "toxic").mapInArrow(featurise, "least long, toxic int, words array<string>")
    sample = sample.groupBy("least").agg(F.max_by(F.struct("toxic", "words"), F.struct("toxic", F.size("words"), "words")).alias("x")).select("least", "x.*").persist()
    try:
        both = {r["toxic"] > 0: (r["n"], r["words"]) for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).collect()}
        if len(both) < 2:
            return OrdinalModel()
        toxic, clean = float(both[True][0]), float(both[False][0])
        # so many documents that no word is likely to be in just toxic ones by chance
        least = np.log(max(1, both[True][1] + both[False][1]) / CHANCE) / np.log((toxic + clean) / toxic)
        shares = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg((F.sum((F.col("toxic") > 0).cast("int")) / F.lit(toxic)).alias("p"), ((F.sum((F.col("toxic") <= 0).cast("int")) + 0.5) / F.lit(clean)).alias("q"))
        best = [r["word"] for r in shares.where((F.col("p") >= LEAST_SHARE) & (F.col("p") * toxic >= float(least)) & (F.col("p") >= LEAST_LIFT * F.col("q"))).orderBy(F.desc(F.col("p") - F.col("q")), "word").limit(FEATURES).collect()]
        if not best:
            return OrdinalModel()
        vocabulary = F.array(*[F.lit(w) for w in best])
        data = sample.select("least", "toxic", F.array_intersect("words", vocabulary).alias("words")).orderBy("least").toArrow().to_pylist()
    finally:
        sample.unpersist()
    place = {w: i for i, w in enumerate(best)}
    x, toxic_rows = np.zeros((len(data), len(best))), np.array([r["toxic"] > 0 for r in data])
    for i, r in enumerate(data):
        x[i, [place[w] for w in r["words"]]] = 1
    held = x.sum(axis=1)
    some = held[toxic_rows & (held > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.zeros(2)
    y = np.where(toxic_rows, 1 + (held > cuts[0]).astype(int) + (held > cuts[1]).astype(int), 0)
    y = np.searchsorted(np.unique(y), y)  # grades that do not occur are left out
    w, theta = fit_ordinal(x, y, positive=True)  # features were chosen for being more frequent in toxic documents
    return OrdinalModel({word: float(w[i]) for word, i in place.items() if w[i] > 0}, [float(t) for t in theta])


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic) of every row; severity is the expected grade."""
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beyond = [model.beyond(t) for t in batch.column(1).to_pylist()]
            p = [b[0] if b else 0.0 for b in beyond]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(sum(b)) for b in beyond], pa.float64()), pa.array(p, pa.float64()), pa.array([x > 0.5 for x in p], pa.bool_())], ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without the rows that the model rejects; the text itself is scored, so no join is needed."""
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not (b and b[0] > 0.5) for b in map(model.beyond, batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
