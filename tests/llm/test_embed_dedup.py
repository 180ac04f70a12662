"""Op 5 against all pairs."""

import duckdb
import numpy as np
import pytest

from millrace.llm import embed_dedup
from millrace.llm.queries import ORACLE_SQL, op5_embedding_dedup
from tests.compare import of_duck, of_spark

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    ids = sorted(vectors)
    ok = {i: v for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: [] for i in ids}
    for a in ids:
        for b in ids:
            if a != b and a in ok and b in ok and len(ok[a]) == len(ok[b]):
                x, y = np.array(ok[a], dtype=np.float32).astype(float), np.array(ok[b], dtype=np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    near[a].append(b)
    parent = {}
    for i in ids:
        if i not in parent:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in parent:
                    parent[j] = i
                    stack += near[j]
    return {i: (len(near[i]), parent[i]) for i in ids}


@pytest.mark.parametrize("block", [8, 1024])
def test_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup.links, "__defaults__", (0.95, embed_dedup.TABLES, embed_dedup.PER_TABLE, block))
    rng = np.random.default_rng(7)
    vectors = {}
    for c in range(12):
        center = rng.normal(size=32)
        for _ in range(15):
            vectors[len(vectors)] = (center + rng.normal(size=32) * 0.12).tolist()
        for _ in range(3):
            vectors[len(vectors)] = (center * (c + 1)).tolist()
    for _ in range(60):
        vectors[len(vectors)] = rng.normal(size=32).tolist()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)).collect()}
    want = brute(vectors)
    assert sum(g[0] for g in got.values()) == sum(w[0] for w in want.values())
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_recall_on_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    x = np.array([vectors[i] for i in sorted(vectors)], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r.n_links for r in embed_dedup.near_duplicates(df).collect())
    assert 0.99 * true <= found <= true


def test_query_like_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 400").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = of_spark(op5_embedding_dedup(spark, str(tmp_path)))
    assert got == of_duck(con, ORACLE_SQL["op5_embedding_dedup"]) and any(not r[2] for r in got)


def test_odd_and_empty(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (7, [1.0, 2.0]), (11, [1e-30, 2e-30])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)]
    assert got == sorted([*alone, (7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (11, 4, 7, False)])
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_null_and_string_ids_and_clashing_columns(spark):
    from tests.llm.helpers import clashing

    rows = [(None, [1.0, 2.0]), ("b", [1.0, 2.0]), ("a", [2.0, 4.0]), (None, [3.0, -1.0]), (None, [6.0, -2.0]), (None, None)]
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id string, embedding array<float>, label int"))
    got = sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.near_duplicates(df).collect()))
    assert got == [("None", 0, "None", True), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 2, "a", False), ("a", 2, "a", True), ("b", 2, "a", False)]
