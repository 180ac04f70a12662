"""Op 11 against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives
from millrace.llm.integers import Lifted, products
from millrace.llm.queries import ORACLE_SQL, op11_hard_negatives
from tests.compare import duck, of_duck, of_spark
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10):
    fit = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (a, u, label) in enumerate(fit):
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i is None, i or 0, l) for other, (i, v, l) in enumerate(fit) if other != at)
        for p, p_null, p_id, l in [s for s in scored if s[3] == label][:5]:
            hits = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a, None if p_null else p_id, r + 1, None if n_null else n, -p, -s) for r, (s, n_null, n, _) in enumerate(hits[:5])]
    return sorted(out, key=repr)


def got(df, every=10):
    found = negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("tree", "leaf", "anchors"), [(4096, 512, 8192), (60, 4, 7)])
def test_like_brute_force(spark, monkeypatch, tree, leaf, anchors):
    for name, value in (("TREE_ROWS", tree), ("LEAF", leaf), ("ANCHORS", anchors)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(9, 8)) * rng.uniform(0.3, 2, size=(9, 1))
    rows = [(i, (centres[rng.integers(9)] + rng.normal(size=8) * 0.1).round(1).tolist(), int(rng.integers(4))) for i in range(500)]
    want = brute(rows)
    assert len(want) > 500 and got(spark.createDataFrame(rows, SCHEMA)) == want


def test_walk_comes_nearest_first_and_skips_what_lies_outside():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(3000, 3)) * 300)
    lifted = Lifted(float((v * v).sum(axis=1).max()), 3)
    tree = negatives.Tree(v, lifted, 16)
    q, ids, ok = np.floor(rng.normal(size=3) * 300), np.arange(3000), np.ones(3000, dtype=bool)
    scores = products(q[None, :], tree.v)[0]
    low, high = np.sort(scores)[[-400, -300]]
    seen = {}
    found = tree.walk(q, ids, ok, low, high, 20, seen)
    assert found == sorted(((int(s), int(i)) for i, s in enumerate(scores) if low <= s <= high), key=lambda x: (-x[0], x[1]))[:20]
    assert sum(b - a for a, b in seen) < 2000


def test_regions_bound_their_rows():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(400, 5)), rng.normal(size=(30, 5))
    top = negatives.TopTree(rows[:100], 8)
    low, high = top.shells(queries)
    far, region = negatives.distances(queries, rows), top.regions_of(rows)
    assert top.depth == 3 and set(region) == set(range(8))
    assert (far >= low[:, region] - 1e-9).all() and (far <= high[:, region] + 1e-9).all()


def test_copies_ties_odd_and_repeated_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (None, [0.9, 0.9], 2), (5, [0.9, 0.9], 2), (5, [0.9, 0.9], 2), (4, [0.9, 0.9], 2), (10, None, 1), (20, [1.0, None], 1), (30, [float("nan")], 2),
            (40, [1.0, 0.8], None), (50, [], 3), (51, [], 3), (60, [-1.0, -1.0], 1), (70, [0.5], 7), (80, [0.0, 0.0], 1), (90, [-1.0, 1.0], 4)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    padded = [(i, v if v is None else v + [0.0] * (2 - len(v)), label) for i, v, label in rows]
    assert got(df) == brute(padded)
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 50")) == []


def test_string_labels_and_large_components(spark):
    rows = [(0, [3e30, 1.0], "a"), (1, [2e30, 1.0], "a"), (2, [1e30, 1.0], "b"), (10, [1.0, 2.0], "a"), (3, [1e9, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()
    assert found and all(80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score for r in found)


def test_query_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    want = of_duck(duck(sf), ORACLE_SQL["op11_hard_negatives"])
    assert want and of_spark(op11_hard_negatives(spark, sf)) == want
