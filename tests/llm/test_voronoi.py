"""Op 13 against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import integers, voronoi
from millrace.llm.queries import ORACLE_SQL, op13_exact_search
from tests.compare import duck, of_duck, of_spark
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, scale=1024, every=100):
    fit = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, u) in enumerate(fit):
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(u, v)), i is None, i or 0) for other, (i, v) in enumerate(fit) if other != at)
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df, **more):
    found = voronoi.top_k(df, F.col("vec_id") % 100 == 0, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 12)) * rng.uniform(0.2, 3, size=(7, 1))
    return [(i * 10, (centres[rng.integers(7)] + rng.normal(size=12) * 0.05).round(2).tolist()) for i in range(n)]


@pytest.mark.parametrize(("queries", "chunk", "piece"), [(1024, 2048, 8192), (5, 16, 50)])
def test_like_brute_force(spark, monkeypatch, queries, chunk, piece):
    for name, value in (("QUERIES", queries), ("CHUNK", chunk), ("SLICE", piece)):
        monkeypatch.setattr(voronoi, name, value)
    rows = clustered(3, 700)
    assert got(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)) == brute(rows)


def test_far_cells_are_not_replicated(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "QUERIES", 1)
    rows = clustered(4, 600)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    v = df.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100 == 0).alias("is_query"), integers.whole("embedding", 1024).alias("v"))
    lifted = integers.Lifted(v.agg(F.max(integers.norm2("v"))).first()[0], 12)
    drawn = np.array([r.v for r in v.limit(24).collect()])
    pivots = [lifted.data(drawn), lifted.query(drawn)]
    spots = voronoi.assigned(v, pivots, lifted)
    data, queries = voronoi.plan(spots, pivots, 10, lifted.slack)
    assert {q[0] for q in queries} == {r.q_cell for r in spots.where("is_query").select("q_cell").distinct().collect()}
    assert len(data) < len({d[1] for d in data}) * len({d[0] for d in data}) and all(d[5] >= 1 and d[6] >= 1 for d in data)


def test_groups_hold_all_cells_and_stay_small():
    between = np.abs(np.arange(20)[:, None] - np.arange(20)[None, :]).astype(float)
    sizes = {i: 3 for i in range(20)} | {7: 100}
    groups = voronoi.groups_of(between, sizes, 10)
    assert sorted(c for g in groups for c in g) == list(range(20))
    assert all(len(g) == 1 or sum(sizes[c] for c in g) <= 10 for g in groups)


def test_copies_ties_odd_and_large_vectors(spark):
    rows = [(100, [0.5, 0.5]), (100, [0.5, 0.5]), (None, [0.5, 0.5]), (7, [0.5, 0.5]), (3, [0.5, 0.5]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]),
            (600, []), (0, [1.0]), (11, [-1.0, 2.0, 3.0]), (12, [3e38, 1.0]), (13, [-3e38, 1.0]), (700, [1e7, -1e7])]
    df = clashing(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA))
    fit = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    longest = max(len(v) for _, v in fit)
    hold = lambda x, n=1 << 63: max(-n, min(n - 1, x))
    ints = [(i, [hold(int(np.floor(1024 * float(np.float32(x))))) for x in v] + [0] * (longest - len(v))) for i, v in fit]
    want = []
    for at, (q, u) in enumerate(ints):
        if q is not None and q % 100 == 0:
            scored = sorted((-hold(sum(a * b for a, b in zip(u, v))), i is None, i or 0) for other, (i, v) in enumerate(ints) if other != at)
            want += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:10])]
    mine = got(df)
    near = lambda rows: sorted(((a, b, c, d // 4096 if abs(d) > 1 << 62 else d) for a, b, c, d in rows), key=repr)  # noqa: E731  2^63 - 1 is no double
    assert near(mine) == near(want)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id = 600")) == []


def test_query_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert of_spark(op13_exact_search(spark, sf)) == of_duck(duck(sf), ORACLE_SQL["op13_exact_search"])
