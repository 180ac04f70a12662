"""Op 9 against a plain as-of search, and the file format's round trip."""

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.queries import ORACLE_SQL, op9_warc_revisits
from tests.compare import duck, of_duck, of_spark

START = dt.datetime(2024, 1, 1)


def test_query_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert of_spark(op9_warc_revisits(spark, sf)) == of_duck(duck(sf), ORACLE_SQL["op9_warc_revisits"])


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Example.com:443/a/?utm_source=x&b=1#f", "example.com/a?b=1"),
        ("http://example.com/a/", "example.com/a"),
        ("http://example.com", "example.com"),
        ("example.com/?utm_medium=1", "example.com"),
        ("http://e.com/p?a=1&utm_x=2&c=3", "e.com/p?a=1&c=3"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("block", "most"), [(60, 100_000), (3600, 7), (10**9, 20), (10**9, 100_000)])
def test_as_of_join(spark, block, most):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = {} if rng.random() < 0.2 else {"etag": rng.choice(['"a"', '"b"', 'W/"a"']), "date": str(i), "x-own": str(i)}
        at = None if rng.random() < 0.03 else START + dt.timedelta(seconds=rng.randint(0, 2000))
        url = None if rng.random() < 0.03 else rng.choice(["http://a.com/", "https://www.a.com", "http://b.com/x"])
        rows.append((i, kind, url, at, {"response": rng.choice([200, 200, 404]), "revisit": 304}.get(kind), headers, bytearray(str(i).encode())))
    df = spark.createDataFrame(rows, warc.RECORD).repartition(4)
    got = {r.record_id: r for r in warc.resolve_revisits(df, block, most).collect()}
    canonical = {"http://a.com/": "a", "https://www.a.com": "a", "http://b.com/x": "b", None: None}
    revisits = [r for r in rows if r[1] == "revisit"]
    assert set(got) == {r[0] for r in revisits}
    for i, _, url, at, _, headers, _ in revisits:
        best = [(r[3], r[0], r) for r in rows if r[1] == "response" and r[4] == 200 and url and at and r[3] and canonical[r[2]] == canonical[url] and r[3] <= at]
        if not best:
            assert got[i].outcome == "no_response"
            continue
        source = max(best, key=lambda b: b[:2])[2]
        assert got[i].source_id == source[0]
        tags = headers.get("etag"), source[5].get("etag")
        want = "no_validator" if None in tags else "resolved" if tags[0].removeprefix("W/") == tags[1].removeprefix("W/") else "validator_mismatch"
        assert got[i].outcome == want
        if want == "resolved":
            assert got[i].headers == {"etag": headers["etag"], "date": headers["date"], "x-own": source[5]["x-own"]}
    resolved = warc.with_payload(warc.resolve_revisits(df, block, most), df).collect()
    assert all(bytes(r.payload) == str(r.source_id).encode() for r in resolved)


def test_files(spark, tmp_path):
    response = warc.render_http(200, {"ETag": '"x"', "Content-Type": "text/html"}, b"<p>\r\n\r\nhi</p>")
    revisit = warc.render_http(304, {"ETag": '"x"'}, b"")
    data = warc.write_record(1, "response", "http://a.com/", "2024-01-01T00:00:00Z", response) + warc.write_record(2, "revisit", "http://a.com", "2024-01-02T00:00:00Z", revisit)
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(data)[:-40])  # its last record is cut off
    records = warc.read_warc(spark, str(tmp_path / "a.warc.gz"))
    assert [r.status for r in records.orderBy("warc_date").collect()] == [200, 304]
    row = warc.resolve_revisits(records).first()
    assert row.outcome == "resolved" and row.headers["content-type"] == "text/html" and row.payload_length == len(b"<p>\r\n\r\nhi</p>")
    assert [f["warc-type"] for f, _ in warc.parse((tmp_path / "b.warc").read_bytes())] == ["response"]


def test_odd_and_empty(spark):
    none = spark.createDataFrame([], warc.RECORD)
    assert warc.resolve_revisits(none).count() == 0
    rows = [(1, "revisit", None, None, 304, None, None), (2, None, None, None, None, None, None), (3, "revisit", "a.com", START, 304, None, None), (3, "revisit", "a.com", START, 304, None, None)]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("url", F.lit(1)).withColumn("source", F.lit(2)).withColumn("outcome", F.lit(3))
    assert [r.outcome for r in warc.resolve_revisits(df).collect()] == ["no_response"] * 3


def test_a_hot_day_is_many_blocks_in_order(spark):
    rows = spark.range(5000).select(F.lit("u").alias("url"), F.timestamp_seconds(F.col("id") * 17 % 86_400).alias("at"))
    parts = warc.in_blocks(rows.union(spark.createDataFrame([(None, None), ("v", START)], "url string, at timestamp")), 86_400, 100).where("url = 'u'")
    sizes = parts.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("block").collect()
    assert len(sizes) == 50 and max(r.n for r in sizes) < 200
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))


def test_clashing_columns(spark):
    from tests.llm.helpers import clashing

    rows = [(1, "response", "a.com", START, 200, {"etag": "x"}, bytearray(b"p")), (None, "revisit", "a.com", START, 304, {"etag": "x"}, None)]
    df = clashing(spark.createDataFrame(rows, warc.RECORD)).withColumns({c: F.lit("q") for c in ("block", "full", "at", "_n", "_url", "_day", "_parts", "local", "carried")})
    assert [(r.record_id, r.source_id, r.outcome) for r in warc.resolve_revisits(df).collect()] == [(None, 1, "resolved")]
