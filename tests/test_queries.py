"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from millrace.plans import registry
from tests.compare import duck, of_duck, of_spark


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert of_spark(registry.QUERIES[name](spark, sf)) == of_duck(duck(sf), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"stream_dedup"}))
def test_runs_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_stream_keeps_what_the_batch_keeps(spark, sf):
    assert of_spark(registry.QUERIES["stream_dedup"](spark, sf)) == of_spark(registry.QUERIES["keep_first_text"](spark, sf))


def test_ngram_ban_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in registry.QUERIES["ngram_ban"](spark, sf).collect():
        b = texts[row.doc_id]
        want = sorted({b[i + 3] for i in range(len(b) - 3) if b[i : i + 3] == b[-3:]})
        assert (row.banned or "") == ",".join(map(str, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["pretoken", "freq"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_llm_part(tmp_path):
    """In a copy of the library from which the subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    found = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"], found.stderr


def test_every_query_reads_a_table():
    """No query is made of literals alone: each reads a table by name, or goes through another query that does."""
    literal = {name for name, sql in registry.ORACLE_SQL.items() if not any(re.search(rf"\b{t}\b", sql) for t in ("documents", "conversations", "embeddings", "events", "pages", "benchmark", "labels", "orders", "lineitem"))}
    assert literal == set()
