"""Blockwise attention, tiles and decoding against plain numpy and Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric
from millrace.operators import attention, matrices
from millrace.plans import registry


def plain_attention(x, heads, theta):
    n, d = x.shape[0], x.shape[1] // heads
    v = x.reshape(n, heads, d)
    k = v if theta is None else attention.rotated(v, np.arange(n), theta)
    out = np.zeros_like(v)
    for i in range(n):
        for h in range(heads):
            s = k[: i + 1, h] @ k[i, h] / d**0.5
            w = np.exp(s - s.max())
            out[i, h] = w / w.sum() @ v[: i + 1, h]
    return out.reshape(n, -1)


@pytest.mark.parametrize(("heads", "theta", "block", "segment"), [(1, None, 256, 64), (2, 100.0, 4, 2), (4, 10000.0, 7, 1)])
def test_attention(spark, heads, theta, block, segment):
    rng = np.random.default_rng(heads)
    contexts = {0: rng.normal(size=(37, 8)) * 3, 5: rng.normal(size=(1, 8)), 9: rng.normal(size=(12, 8)) * 40}
    rows = [(c, i, r.tolist(), r.tolist(), r.tolist()) for c, x in contexts.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "context long, position long, q array<double>, k array<double>, v array<double>")
    got = {(r.context, r.position): r.out for r in attention.causal(df, heads, theta, block, segment).collect()}
    assert len(got) == len(rows)
    for c, x in contexts.items():
        want = plain_attention(x, heads, theta)
        assert np.allclose([got[c, i] for i in range(len(x))], want, atol=1e-9)


def test_attention_of_one_context_is_many_tasks(spark):
    rows = spark.range(64).select(F.lit(0).cast("long").alias("context"), F.col("id").alias("position"), *[F.array(F.lit(1.0), F.lit(2.0)).alias(c) for c in "qkv"])
    plan = attention.causal(rows, block=8, segment=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [context" in plan and "own" in plan


def test_what_attention_sends_does_not_grow_with_the_square(spark):
    for n in (3000, 48_000):
        assert n / attention.stretch(n - 1, 64, 2) <= attention.STRETCHES
    assert attention.stretch(10**9, 64, 2) <= attention.LONGEST and attention.stretch(0, 64, 2) == 128
    x = np.random.default_rng(0).normal(size=(700, 4))
    rows = spark.createDataFrame([(3, i, r.tolist(), r.tolist(), r.tolist()) for i, r in enumerate(x)], "context long, position long, q array<double>, k array<double>, v array<double>")
    found = attention.causal(rows, heads=2, theta=100.0, block=8, segment=1)
    got = {r.position: r.out for r in found.collect()}
    assert np.allclose([got[i] for i in range(700)], plain_attention(x, 2, 100.0), atol=1e-9)


def long_form(spark, parts):
    rows = [(m, i, j, float(v)) for m, x in parts.items() for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "module long, i long, j long, v double")


def test_tiles(spark):
    rng = np.random.default_rng(0)
    a, b = ({m: rng.normal(size=(7 + m, 5)) for m in range(2)}, {m: rng.normal(size=(5, 9)) for m in range(2)})
    w = {m: rng.normal(size=(7 + m, 9)) for m in range(2)}
    ta, tb, tw = (matrices.tiles(long_form(spark, x), 4) for x in (a, b, w))
    got = {(r.module, r.i, r.j): r.v for r in matrices.untiled(matrices.tile_product(ta, tb, 4), 4).collect()}
    for gated in (True, False):
        fold = {(r.module, r.i, r.j): r.v for r in matrices.untiled(matrices.fold_tiles(tw, ta, tb, 0.5, gated, 4), 4).collect()}
        for m in range(2):
            ab = a[m] @ b[m]
            change = 0.5 * ab * (w[m] if gated else 1)
            for (i, j), v in np.ndenumerate(ab):
                assert abs(got[m, i, j] - v) < 1e-9 and abs(fold[m, i, j] - w[m][i, j] - change[i, j]) < 1e-9
        norms = lambda x: np.mean([np.linalg.norm(v) for v in x.values()])
        ratio = np.mean([np.linalg.norm(0.5 * a[m] @ b[m] * (w[m] if gated else 1)) / np.linalg.norm(w[m]) for m in range(2)])
        told = matrices.adapter_summary_tiles(tw, ta, tb, 0.5, gated, 4).first()
        assert np.allclose(tuple(told), (norms(a), norms(b), ratio))


def test_tiles_that_miss_entries(spark):
    w = matrices.tiles(long_form(spark, {0: np.ones((3, 3))}).where("i <> j"), 2)
    none = matrices.tiles(long_form(spark, {1: np.ones((2, 2))}), 2)
    got = {(r.i, r.j): r.v for r in matrices.untiled(matrices.fold_tiles(w, none, none, 1.0, True, 2), 2).where("i < 3 and j < 3").collect()}
    assert got == {(i, j): float(i != j) for i in range(3) for j in range(3) if (i, j) != (2, 2)}  # a tile without an entry is not there
    assert matrices.tile_product(w.limit(0), none, 2).count() == 0


def plain_decode(prompt, logits_of, steps, end, penalty, ngram, ban, context):
    tokens = list(prompt)
    for _ in range(steps):
        x = list(logits_of(tokens[-context:]))
        for t in set(tokens):
            x[t] = x[t] * penalty if x[t] < 0 else x[t] / penalty
        for i in range(len(tokens) - ngram + 1):
            if ngram > 1 and tokens[i : i + ngram - 1] == tokens[-(ngram - 1) :]:
                x[tokens[i + ngram - 1]] = -np.inf
        for t in ban:
            if t != end:
                x[t] = -np.inf
        token = int(np.argmax(x))
        if token == end:
            break
        tokens.append(token)
    return tokens[len(prompt) :]


@pytest.mark.parametrize(("steps", "ngram", "context"), [(12, 3, 256), (7, 2, 2), (0, 3, 4)])
def test_greedy_decoding(spark, steps, ngram, context):
    rng = np.random.default_rng(steps)
    tables = rng.normal(size=(30, 10))
    rows = [(i, x.tolist(), [i % 10, (i * 3) % 10]) for i, x in enumerate(tables)]
    df = spark.createDataFrame(rows, "id long, x array<double>, prompt array<int>")
    turned = lambda seen: F.transform("x", lambda _, i: F.get("x", ((i + F.element_at(seen, -1) + F.element_at(seen, 1)) % 10).cast("int")))
    got = {r.id: r.t for r in df.select("id", numeric.decoded(F.col("prompt"), turned, steps, 4, 1.3, ngram, (2, 4), context).alias("t")).collect()}
    for i, x in enumerate(tables):
        want = plain_decode(rows[i][2], lambda seen: [x[(k + seen[-1] + seen[0]) % 10] for k in range(10)], steps, 4, 1.3, ngram, (2, 4), context)
        assert got[i] == want


def test_a_step_of_decoding_computes_its_parts_once(spark, sf):
    """What is banned and the tokens that the logits follow are not computed anew for each of the logits."""
    for name in ("greedy_decode", "sampled_decode"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"array_contains\((?!lambda )", plan) == [] and "element_at(slice(" not in plan and "array_contains(" in plan
    once = numeric.without(F.col("x"), numeric.banned_next(F.concat("t", "t"), 2))
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0, 1]), (None, [0]), ([1.0], None)], "x array<double>, t array<int>").coalesce(1)
    assert [r[0] for r in df.select(once).collect()] == [[-np.inf, 2.0, 3.0], None, [1.0]]


def test_picked(spark):
    df = spark.createDataFrame([([0.2, 0.0, 0.8], u) for u in (0.0, 0.19, 0.2, 0.99, 1.0)], "p array<double>, u double")
    assert [r[0] for r in df.coalesce(1).select(numeric.picked(F.col("p"), F.col("u"))).collect()] == [0, 0, 2, 2, 2]


def test_optimizer_steps(spark):
    rng = np.random.default_rng(6)
    w, g = rng.normal(size=5), [rng.normal(size=5) for _ in range(3)]
    blocks = spark.createDataFrame([("a", 0, w.tolist()), ("b", 0, w.tolist())], "name string, start long, values array<double>")
    params, m, v, want = matrices.parameters(blocks), np.zeros(5), np.zeros(5), w.copy()
    for t, own in enumerate(g, 1):
        params = matrices.optimizer_step(params, spark.createDataFrame([("a", 0, own.tolist())], "name string, start long, g array<double>"), 0.1, 0.2)
        want = want * (1 - 0.1 * 0.2)
        m, v = 0.9 * m + 0.1 * own, 0.999 * v + 0.001 * own * own
        want = want - 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    got = {r.name: (r.w, r.t) for r in params.collect()}
    assert np.allclose(got["a"][0], want, atol=1e-12) and got["a"][1] == 3
    assert got["b"] == (w.tolist(), 0)
