"""WARC records and the resolution of not-modified revisits.

A server-not-modified revisit holds no payload. An as-of join by canonical URL finds the latest earlier full
response; the validators of both are compared, and of the revisit's headers those that a 304 may update are merged
into the stored ones.

Outcomes: ``resolved``; ``no_response`` (nothing earlier, or the URL is null); ``validator_mismatch``;
``no_validator`` (the two share neither an ETag nor a Last-Modified). Defined cases: at one instant a response
comes before a revisit and a smaller record id before a larger; rows without a date are never sources and stay
unresolved; repeated rows resolve each on their own; a null record id comes before others at one instant and stays null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, cut, prepare

#: Header fields of a 304 that replace stored ones (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Captures of one URL are joined in blocks of so many seconds; a block with more captures than ``BLOCK_ROWS`` is cut evenly into as many
#: parts as leave about so many to each, so that a hot URL spreads over tasks.
BLOCK_SECONDS, BLOCK_ROWS = 86_400, 100_000
RECORD = "record_id long, warc_type string, target_uri string, warc_date timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, fragment, default port, www., utm_ parameters or trailing slash; lower-case host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&{2,}", "&"), r"\?&", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def etag_value(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def in_blocks(slim: DataFrame, seconds: int, most: int) -> DataFrame:
    """``slim`` (url, at, ...) with ``block``, a number that grows with time: days, or parts of a day where a URL has more rows in it."""
    width = seconds * 1_000_000
    day = F.floor(F.unix_micros("at") / F.lit(width))
    dense = slim.groupBy(F.col("url").alias("_url"), day.alias("_day")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    dense = cut(dense.select("_url", "_day", F.ceil(F.col("_n") / most).alias("_parts")))
    few = dense.count() <= BROADCAST_ROWS
    joined = slim.join(F.broadcast(dense) if few else dense, (F.col("url") == F.col("_url")) & (day == F.col("_day")), "left")
    part = F.floor(F.pmod(F.unix_micros("at"), F.lit(width)) * F.coalesce("_parts", F.lit(1)) / width)
    return joined.withColumn("block", F.struct(day.alias("day"), part.alias("part"))).drop("_url", "_day", "_parts")


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each not-modified revisit: (record_id, source_id, outcome, headers, payload_length, payload_sha256).

    Only slim columns are shuffled; the payload itself is at ``source_id``, see ``with_payload``.
    """
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200), F.lit(False))
    unmodified = F.coalesce((F.col("warc_type") == "revisit") & (F.col("status") == 304), F.lit(False))
    slim = records.where(full | unmodified).select(
        "record_id", full.alias("full"), canonical_url(F.col("target_uri")).alias("url"), F.col("warc_date").alias("at"), "headers",
        F.octet_length("payload").alias("payload_length"), F.sha2("payload", 256).alias("payload_sha256"),
    )
    slim = in_blocks(slim, block_seconds, block_rows)
    source = F.when(F.col("full") & F.col("at").isNotNull(), F.struct(F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), "payload_length", "payload_sha256"))
    usable = slim.where(F.col("url").isNotNull() & F.col("at").isNotNull())
    order = [F.col("at"), F.desc("full"), F.col("record_id")]
    inside = Window.partitionBy("url", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = usable.withColumn("source", source).withColumn("local", F.last("source", ignorenulls=True).over(inside))
    last = usable.where("full").groupBy("url", "block").agg(F.max_by(F.struct(F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), "payload_length", "payload_sha256"), F.struct("at", "record_id")).alias("carried"))
    blocks = usable.select("url", "block").distinct().join(last, ["url", "block"], "left")
    earlier = blocks.select("url", "block", F.last("carried", ignorenulls=True).over(Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    told = local.where("not full").join(earlier, ["url", "block"], "left").select("record_id", "headers", F.coalesce("local", "carried").alias("s"))
    lost = slim.where(~F.col("full") & (F.col("url").isNull() | F.col("at").isNull())).select("record_id", "headers", F.lit(None).cast(told.schema["s"].dataType).alias("s"))
    both = told.unionByName(lost).select("record_id", "headers", "s.*")
    value = lambda side, name: F.try_element_at(F.col(side), F.lit(name))
    tags = etag_value(value("headers", "etag")), etag_value(value("stored", "etag"))
    dates = value("headers", "last-modified"), value("stored", "last-modified")
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    outcome = F.when(F.col("source_id").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k))
    good = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "source_id", "outcome", F.when(good, F.map_concat(kept, fresh)).alias("headers"),
        F.when(good, F.col("payload_length")).alias("payload_length"), F.when(good, F.col("payload_sha256")).alias("payload_sha256"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved`` with the payload of the response that each revisit stands for."""
    payloads = records.where("warc_type = 'response'").select(F.col("record_id").alias("source_id"), "payload")
    return resolved.where("outcome = 'resolved'").join(payloads, "source_id")


def render_http(status: int, headers: dict[str, str], payload: bytes) -> bytes:
    lines = [f"HTTP/1.1 {status} X", *(f"{k}: {v}" for k, v in headers.items())]
    return "\r\n".join([*lines, "", ""]).encode() + payload


def write_record(record_id: int, kind: str, uri: str, date: str, block: bytes) -> bytes:
    """One gzip member with a WARC/1.1 record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a plain or gzipped WARC file; a cut-off tail is dropped."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            if not line or not fields.get("content-length", "").isdigit():  # cut off within its header
                return
            size = int(fields["content-length"])
            block = stream.read(size)
            if len(block) < size:
                return
            yield fields, block
    except EOFError:
        return


def parse_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    parts = first.split()
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest) if k.strip()}
    return int(parts[1]) if len(parts) > 1 and parts[0].startswith("HTTP/") and parts[1].isdigit() else None, headers, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path`` in the schema RECORD, but for record_id, which is the WARC-Record-ID; read by Spark's own readers."""
    prepare(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for fields, block in parse(data):
                    kind = fields.get("warc-type")
                    status, headers, payload = parse_http(block) if kind in ("response", "revisit") else (None, {}, block)
                    row = [fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), status, list(headers.items()), payload]
                    kinds = [pa.string()] * 4 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["urn", "warc_type", "target_uri", "warc_date", "status", "headers", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(each, "urn string, warc_type string, target_uri string, warc_date string, status int, headers map<string,string>, payload binary")
    return rows.select(F.col("urn").alias("record_id"), "warc_type", "target_uri", F.to_timestamp("warc_date").alias("warc_date"), "status", "headers", "payload")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages`` as WARC records: each page is captured once in full and asked for again once.

    The response is taken ``page_id`` minutes after the start. The second request comes (31 page_id mod 1000) - 100
    minutes later, so some come before any response; each fifth sends an outdated tag. Record ids are 2 page_id and
    2 page_id + 1.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    start = F.lit(1_704_067_200)
    again = F.col("page_id") + F.pmod(F.col("page_id") * 31, F.lit(1000)) - 100
    date = lambda minutes: F.timestamp_seconds(start + minutes * 60)
    common = lambda *more: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in more]), F.array(*[v for _, v in more]))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), date(F.col("page_id")).alias("warc_date"), F.lit(200).alias("status"),
        common(("content-type", F.lit("text/html")), ("etag", tag), ("date", F.col("page_id").cast("string"))).alias("headers"), F.encode("html", "utf-8").alias("payload"),
    )
    sent = F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), date(again).alias("warc_date"), F.lit(304).alias("status"),
        common(("content-type", F.lit("text/plain")), ("etag", sent), ("date", again.cast("string"))).alias("headers"), F.lit(None).cast("binary").alias("payload"),
    )
    return response.unionByName(revisit)
