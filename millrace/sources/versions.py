"""Versions of a table of which the latest ones are kept.

A version is a folder of its own, and counts once a mark of its number stands beside it, which is made when all its files are
there. So a reader finds a whole latest version whatever step a writer broke off at; what it left is removed by the next commit.
Older versions lose their mark before their files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.store import file_system, remove


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, found = file_system(spark, path)
    if not fs.exists(found):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(found)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that count, oldest first."""
    return _numbers(spark, path, "_done-")


def commit_steps(df: DataFrame, path: str, keep: int = 1) -> Iterator[str]:
    """The steps of a commit, each done when its name comes; ``commit`` takes all of them."""
    spark = df.sparkSession
    known = _numbers(spark, path, "version-") + versions(spark, path)
    number = max(known, default=-1) + 1
    df.write.parquet(f"{path}/version-{number}")
    yield "written"
    fs, mark = file_system(spark, f"{path}/_done-{number}")
    fs.create(mark, True).close()
    yield "counts"
    kept = versions(spark, path)[-keep:]
    for old in versions(spark, path):
        if old not in kept:
            remove(spark, f"{path}/_done-{old}")
            yield f"unmarked {old}"
    for old in _numbers(spark, path, "version-"):
        if old < number and old not in kept:
            remove(spark, f"{path}/version-{old}")
            yield f"removed {old}"


def commit(df: DataFrame, path: str, keep: int = 1) -> int:
    """``df`` as the newest version at ``path``; ``keep`` versions stay. One writer at a time. The number of the version."""
    for _ in commit_steps(df, path, keep):
        pass
    return versions(df.sparkSession, path)[-1]


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that counts, an error if there is none."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path}/version-{found[-1]}")
