"""Components and buckets, hot ones included, against plain versions."""

import random

import pytest

from millrace.llm import common


def slow(edges):
    least = {n: n for e in edges if None not in e for n in e}
    again = True
    while again:
        again = False
        for a, b in edges:
            if a is not None and b is not None and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                again = True
    return {n: c for n, c in least.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}


@pytest.mark.parametrize("few", [2, 200])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(few)
    edges = [(500, i) for i in range(501, 540)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(700 + i, 699 + i) for i in range(1, 12)] + [(3, None), (90, 90)]
    got = common.connected_components(common.prepare(spark).createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == slow(edges)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 500_000])
def test_every_pair_of_a_bucket_meets(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [(key, i) for key, n in ((1, 1), (2, 2), (3, 5), (4, 23), (5, 31)) for i in range(n)]
    got = common.crowded(common.prepare(spark).createDataFrame(rows, "key long, id long"), "key", "id", 5).collect()
    groups = {}
    for r in got:
        assert r["_own"] in (r["_a"], r["_b"])
        groups.setdefault((r.key, r["_a"], r["_b"]), []).append(r.id)
    assert all(len(ids) == len(set(ids)) for ids in groups.values())
    met = {(k[0], i, j) for k, ids in groups.items() for i in ids for j in ids if i < j}
    assert met == {(key, i, j) for key, i in rows for k, j in rows if k == key and i < j}
