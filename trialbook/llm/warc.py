"""WARC archives: writing captures as records, reading records, assembling transactions.

A capture is written as three records that belong together: request, response (or a revisit
of an equal payload) and metadata. Request and metadata name the response or revisit in
WARC-Concurrent-To. Archives are gzip-compressed text files of Spark's own writer, whose line
separator is the end of a WARC record; so task commits make them whole and lost tasks are
written again. Reading splits at the version line and puts records that hold it in their
block together again by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices
from trialbook.operators.attach import attach
from trialbook.session import checkpoint_folder, pin

END = "\r\n\r\n"
VERSION = "WARC/1.0\r\n"
DATE = "2026-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORDS = (
    "file string, record_id string, record_type string, concurrent_to array<string>, target_uri string, "
    "warc_date string, digest string, payload_bytes long, block binary, payload binary, complete boolean"
)


def sha1_base32(value: Column) -> Column:
    """Upper-case base32 SHA-1: each 20 bits (5 hex digits) are 4 digits of base 32."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(value: Column) -> Column:
    """A header value without line ends."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str, ident: Column, block: Column, content: str, *headers: Column) -> Column:
    """A record without its end; null headers are left out."""
    named = F.concat(
        F.lit(f"{VERSION}WARC-Type: {kind}\r\nWARC-Record-ID: "), ident, F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        *(F.coalesce(F.concat(h, F.lit("\r\n")), F.lit("")) for h in headers),
        F.lit(f"Content-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(named, block)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a capture per row of ``pages`` below ``folder``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the smallest key
    are responses and the others revisits; rows with smaller payloads are all responses.
    Null payload is empty; a null key is no smallest one unless all are null, and is written
    as no page-id; a null url is written as no target. Repeated rows are captures of their own.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body"))
    rows = rows.select("*", sha1_base32(F.encode("_body", "UTF-8")).alias("_digest"))
    large = rows.where(F.octet_length("_body") >= min_bytes)
    groups = large.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    rows = attach(rows, groups.where("_n > 1").select("_digest", "_first", F.lit(True).alias("_shared")), ["_digest"])
    again = F.coalesce(F.col("_shared"), F.lit(False)) & ~F.col("_key").eqNullSafe(F.col("_first"))
    rows = rows.select("_key", "_url", "_body", "_digest", again.alias("_again"), *(F.expr("concat('<urn:uuid:', uuid(), '>')").alias(f"_id{k}") for k in range(3)))
    target = F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("_url")))
    together = F.concat(F.lit("WARC-Concurrent-To: "), F.col("_id1"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"))
    host = F.coalesce(F.regexp_extract("_url", r"^[a-z]+://([^/\s]+)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("_url", r"^[a-z]+://[^/\s]+(/\S*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("_key").cast("string"), F.lit("\r\n")), F.lit(""))
    http = "application/http; msgtype="
    capture = F.when(
        F.col("_again"), _record("revisit", F.col("_id1"), F.lit(HTTP), f"{http}response", target, digest, F.lit(f"WARC-Profile: {REVISIT}"))
    ).otherwise(_record("response", F.col("_id1"), F.concat(F.lit(HTTP), F.col("_body")), f"{http}response", target, digest))
    records = F.array(
        _record("request", F.col("_id0"), asked, f"{http}request", target, together),
        capture,
        _record("metadata", F.col("_id2"), about, "application/warc-fields", target, together),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(folder)


def _parsed(file: str, chunk: bytes) -> dict | None:
    """The record that begins with ``chunk`` (what follows a version line), or nothing if its
    block or its headers go on after the chunk's end."""
    head, end, rest = chunk.partition(b"\r\n\r\n")
    if not end:
        return None
    headers: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: headers.get(name, [None])[0]
    length = one("content-length") or "0"
    if not (length.isascii() and length.isdigit()):
        return {"file": file, "record_id": one("warc-record-id"), "record_type": one("warc-type"), "complete": False}
    size = int(length)
    if len(rest) < size:
        return None
    block = rest[:size]
    payload = block.partition(b"\r\n\r\n")[2] if (one("content-type") or "").startswith("application/http") else block
    kind, digest = one("warc-type"), one("warc-payload-digest")
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "file": file, "record_id": one("warc-record-id"), "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"),
        "warc_date": one("warc-date"), "digest": digest.removeprefix("sha1:") if digest else None,
        "payload_bytes": None if kind == "revisit" else len(payload), "block": block, "payload": payload, "complete": True,
    }


def read_archives(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The records of the gzip archives below ``folder``, columns as in ``RECORDS``.

    ``digest``: of a response's payload as read, else the digest that the record names. A
    record cut off by the end of its file, or whose length is no number, has complete false and
    no block. ``blocks``: False
    leaves block and payload of responses null, so that they are not carried on.
    """
    chunks = spark.read.option("lineSep", VERSION).text(folder)
    chunks = chunks.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def table(rows: list[dict]) -> pa.RecordBatch:
        text, many = pa.string(), pa.list_(pa.string())
        kinds = [text, text, text, many, text, text, text, pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def run(batches):
        file, held = None, None  # held: a record whose end has not been read yet
        for batch in slices(batches):
            out = []
            for path, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != file:
                    out += [{"file": file, "complete": False}] * (held is not None)
                    file, held = path, None
                if held is None:
                    if not chunk.strip():
                        continue  # before the first version line
                    held = [chunk]
                else:
                    held += [VERSION.encode(), chunk]
                record = _parsed(file, held[0] if len(held) == 1 else b"".join(held))
                if record is not None:
                    if not blocks and record["record_type"] in ("response", "revisit"):
                        record["block"] = record["payload"] = None
                    out.append(record)
                    held = None
            if out:
                yield table(out)
        if held is not None:
            yield table([{"file": file, "complete": False}])

    return chunks.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response or revisit), ``requests`` and
    ``metadata`` (the records that are concurrent to it; empty where there are none).

    Records of other kinds and records without an id are left out.
    """
    whole = records.where(F.col("complete") & F.col("record_id").isNotNull())
    answers = whole.where(F.col("record_type").isin("response", "revisit"))
    answers = answers.select("record_id", F.struct(*[c for c in answers.columns]).alias("capture"))
    others = whole.where(F.col("record_type").isin("request", "metadata"))
    others = others.select(F.explode("concurrent_to").alias("record_id"), F.struct("record_id", "record_type", "block").alias("other"))
    # a capture has a handful of these
    sides = others.groupBy("record_id").agg(F.array_sort(F.collect_list("other")).alias("others"))
    joined = answers.join(sides, "record_id", "left")
    empty = F.coalesce("others", F.array().cast("array<struct<record_id:string,record_type:string,block:binary>>"))
    return joined.select(
        "capture",
        F.filter(empty, lambda o: o["record_type"] == "request").alias("requests"),
        F.filter(empty, lambda o: o["record_type"] == "metadata").alias("metadata"),
    )


def resolved(transactions: DataFrame) -> DataFrame:
    """Per capture: page_id (of its metadata), payload_bytes, payload_digest, record_type and,
    for revisits, refers_to: the smallest page_id among the responses of the same payload."""
    fields = F.decode(F.element_at("metadata", 1)["block"], "UTF-8")
    fields = F.when(F.size("metadata") > 0, fields)
    page = F.nullif(F.regexp_extract(fields, r"(?m)^page-id: (-?[0-9]+)", 1), F.lit("")).cast("long")
    rows = transactions.select(
        page.alias("page_id"), F.col("capture.payload_bytes").alias("own_bytes"), F.col("capture.digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
    )
    sources = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("source"), F.max("own_bytes").alias("bytes"))
    revisited = rows.where("record_type = 'revisit'").select("payload_digest").distinct()
    sources = sources.join(revisited, "payload_digest", "left_semi")
    found = attach(rows, sources, ["payload_digest"])
    again = F.col("record_type") == "revisit"
    return found.select(
        "page_id",
        F.when(again, F.col("bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(again, F.col("source")).alias("refers_to"),
    )


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back and resolve each capture."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = pin(read_archives(spark, folder, blocks=False))
    return resolved(pin(captures(records)))
