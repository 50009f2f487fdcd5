"""WARC archives: written one gzip member per record, read back in splits.

Writing: each task writes one archive under a name of its own in the shared folder and
renames it when it is complete, so a lost or repeated attempt leaves no half file; the
names of complete files come back as rows. Records are WARC/1.1: a response holds an HTTP
block whose body is the payload, a revisit the HTTP head alone, with the digest and the page
it refers to. The page's id, and a URL that had to be changed to be one, stand in extension
fields. One shuffle carries the payloads to the rows that say which are revisits.

Reading: tasks get byte ranges, as many tasks as ranges. Inside its range a task looks for
the gzip magic, accepts a place when a member decodes there and starts with a WARC header,
and owns the records that start inside, reading past its end to finish the last. Chance magic
inside compressed data doesn't decode to a header and is passed over. Bytes are read once, in
order; memory holds one record. Archives of others are read too: what isn't there is null.

Null html is the empty payload. Of rows with equal payloads of at least ``least`` bytes,
that with the largest page_id is the response and the others revisit it; rows equal in
page_id as well are all responses, and a null id counts as smallest. Other columns are
ignored, whatever their names. An empty table gives no file and no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.tables import opened, shared_dir, written

MAGIC, SPLIT, AHEAD = b"\x1f\x8b\x08", 16 << 20, 1 << 20
#: Start of a record, and how much of one must be seen to know it.
NAME = b"WARC/"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: The date of records, as the pages have none; and the profile of a revisit, a fixed value.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One member: the head, and the HTTP block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}" if target else "", f"X-Url: {quote(url, safe='')}" if target != url or target == "" else "",
        f"X-Page: {page_id}" if page_id is not None else "", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Profile: {PROFILE}" if revisit else "", f"X-Refers-To-Page: {refers_to}" if revisit else "",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    text = "\r\n".join(x for x in lines if x) + "\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdecimal() and abs(int(text)) < 2**63 else None


def parsed(member: bytes) -> tuple:
    """A record's row; an HTTP block's payload is what follows its head."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: length] if (length := _number(fields.get("content-length"))) is not None else rest
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest")
    body, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        http_head, _, body = block.partition(b"\r\n\r\n")
        http = _fields(http_head)
    revisit = kind == "revisit"
    raw = fields.get("x-url")
    return (
        _number(fields.get("x-page")), fields.get("warc-target-uri") if raw is None else unquote(raw),
        _number(http.get("content-length")) if revisit else len(body), (stated.rpartition(":")[2] if stated else None) if revisit else sha1_base32(body),
        kind, _number(fields.get("x-refers-to-page")),
    )


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives; one row (path, size) per file."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    light = keyed.where(F.col("n") >= least).select("page_id", "sha", "n")
    largest = light.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    revisits = light.join(largest, ["sha", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()
    a, b = keyed.alias("a"), revisits.alias("b")
    rows = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha") == F.col("b.sha")), "left")
    rows = rows.select("a.page_id", "a.url", "a.html", "b.refers_to", F.col("b.sha").isNotNull().alias("revisit"))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    fs, base = opened(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name + ".open", compression=None)
                out.write(record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), revisit.as_py()))
        if out is not None:
            out.close()
            fs.move(name + ".open", name + ".warc.gz")
            size = fs.get_file_info(name + ".warc.gz").size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}.warc.gz"]), pa.array([size], pa.int64())], ["path", "size"])

    return rows.mapInArrow(archived, "path string, size long")


def members(path: str, size: int, start: int, stop: int) -> Iterator[bytes]:
    """The decoded records that start in [start, stop)."""
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        f.seek(start)
        held, at = b"", start  # bytes read from place ``at`` on

        def more() -> bool:
            nonlocal held
            data = f.read(AHEAD)
            held += data
            return bool(data)

        while at < stop:
            k = held.find(MAGIC)
            if k < 0:
                keep = min(len(held), len(MAGIC) - 1)
                at += len(held) - keep
                held = held[len(held) - keep :]
                if not more():
                    return
                continue
            at, held = at + k, held[k:]
            if at >= stop:
                return
            whole, used = _member(held, more, lambda: held)
            if whole is None:
                at, held = at + 1, held[1:]
            else:
                yield whole
                at, held = at + used, held[used:]


def _member(first: bytes, more, all_) -> tuple[bytes | None, int]:
    """The record that a gzip member at the start of the bytes holds, and its length; none where there is none."""
    decoder, out, fed, seen = zlib.decompressobj(31), [], 0, b""
    try:
        while not decoder.eof:
            data = all_()[fed:]
            if not data:
                if not more():
                    return None, 0
                continue
            fed += len(data)
            out.append(decoder.decompress(data))
            if len(seen) < len(NAME):
                seen = b"".join(out)[: len(NAME)]
                if not NAME.startswith(seen):
                    return None, 0
    except zlib.error:
        return None, 0
    whole = b"".join(out)
    return (whole, fed - len(decoder.unused_data)) if whole.startswith(NAME) and b"\r\n\r\n" in whole else (None, 0)


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of the listed archives, one row each."""
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = written(ranges, "warc-ranges")
    many = ranges.count()
    ranges = ranges.repartition(max(many, 1), "path", "start")  # with a number, adaptive planning leaves them apart

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]

        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names, dtype=object)
            return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

        rows: list[tuple] = []
        for ranges_ in frames:
            for path, size, start in zip(ranges_["path"], ranges_["size"], ranges_["start"], strict=True):
                for whole in members(path, size, start, min(start + split, size)):
                    rows.append(parsed(whole))
                    if len(rows) >= 4096:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return ranges.mapInPandas(records, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(spark, written(write(pages, folder, least), "warc-files"))
