"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are range-partitioned by id with splitters drawn by a fixed hash, and sorted inside each
range, so the same table always gives the same files. A task writes its range as gzip members, rolls
to the next file at a compressed size, and writes under a temporary name that is renamed when the file
is whole. The manifest, written last, lists the files that count; leftovers of lost attempts are
in no manifest and are never read.

Of records with equal payloads the one with the largest id is the response; the others are revisits
that keep their own HTTP header and refer to it. Payloads shorter than `least_bytes` are all responses.

Edge cases: null html is an empty payload; null urls become `about:blank`; line breaks in a url are
escaped; repeated ids are written each; a very long payload fills a file by itself; an empty table
writes an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import hash_sample, landed, range_of

#: A file is closed once it holds this many compressed bytes.
ROLL_BYTES = 64 << 20
#: Bytes of payload in a range, and ids drawn for the splitters.
RANGE_BYTES = 8 << 20
SAMPLE, IDS_PER_PART = 8192, 24
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, records long, bytes long, sha256 string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One whole record; a revisit keeps the HTTP header, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without time stamp, so equal data gives equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Write the ranges of one task; rows come sorted by range and id."""
    files, root = _filesystem(folder)
    done, shard, number, out = [], None, 0, None

    def close():
        nonlocal out, number
        if out is not None:
            out["stream"].close()
            files.move(out["temporary"], f"{root}/{out['name']}")
            done.append((out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))
            out, number = None, number + 1

    repeats: dict[bytes, int] = {}  # of the id at hand: payload digest -> the response's id
    last = None
    for batch in batches:
        for at, page_id, url, html, digest, response in zip(*batch.columns, strict=True):
            page_id = page_id.as_py()
            if page_id != last:
                repeats.clear()
                last = page_id
            if response.is_valid:  # such rows come before the records of their id
                repeats[bytes.fromhex(digest.as_py())] = response.as_py()
                continue
            payload = (html.as_py() or "").encode()
            if at.as_py() != shard:
                close()
                shard, number = at.as_py(), 0
            if out is None:
                name = f"shard-{shard:06d}-{number:04d}.warc.gz"
                temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                out = {"name": name, "temporary": temporary, "stream": files.open_output_stream(temporary, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
            refers_to = repeats.get(hashlib.sha256(payload).digest()) if repeats else None
            data = _member(record(page_id, url.as_py(), payload, refers_to))
            out["stream"].write(data)
            out["records"] += 1
            out["bytes"] += len(data)
            out["sha"].update(data)
            if out["bytes"] >= roll:
                close()
    close()
    if done:
        columns = [pa.array(c) for c in zip(*done, strict=True)]
        yield pa.record_batch(columns, ["file", "records", "bytes", "sha256"])


def _splitters(pages: DataFrame, id_col: str, parts: int) -> list:
    """Quantiles of ids that a fixed hash picks: some for each part, in all little more than the driver asks for."""
    drawn = pages.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    ids = sorted(r.id for r in hash_sample(drawn, max(SAMPLE, IDS_PER_PART * parts), drawn.count(), "id").collect())
    return sorted({ids[len(ids) * i // parts] for i in range(1, parts)}) if ids else []


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, digest, response) of the rows that repeat another row's payload; moves no payloads."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = landed(
        pages.select(F.col(id_col).alias("id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")),
        "payload-digests",
    )
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
    several = landed(first.where("copies > 1").drop("copies"), "payload-responses")
    return rows.join(several, "digest").where("id <> response").select("id", "digest", "response").distinct()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Write all rows to `folder` (shared by all executors); returns the manifest."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    bounds = _splitters(pages, id_col, max(1, -(-total // range_bytes)))
    # Rows without an id go first.
    shard = range_of(spark, F.coalesce("id", F.lit(-(1 << 63))), bounds)
    text = [F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    none = F.lit(None).cast("string")
    records = pages.select(F.col(id_col).cast("long").alias("id"), *text, none.alias("digest"), F.lit(None).cast("long").alias("response"))
    repeats = revisits(pages, id_col, html_col, least_bytes).select("id", none.alias("url"), none.alias("html"), "digest", "response")
    rows = (
        records.unionByName(repeats)
        .select(shard.alias("shard"), "id", "url", "html", "digest", "response")
        .repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "id", F.isnull("response"), "url", "html")
    )
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    rows.mapInArrow(partial(_write, folder=folder, roll=roll_bytes), _MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _lines(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n") if b":" in line)
    return {k.decode().strip().lower(): v.decode().strip() for k, v in pairs}


def _page(value: str | None) -> int | None:
    number = value.rpartition(":")[2].rstrip(">") if value else "None"
    return None if number == "None" else int(number)


def parse(data: bytes) -> tuple:
    """A record's fields; digests are computed again and must agree with its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _lines(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_lines(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest differs in {fields['warc-record-id']}")
    kind = fields["warc-type"]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
        raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
    return _page(fields["warc-record-id"]), length, digest, kind, _page(fields.get("warc-refers-to")), fields["warc-target-uri"], payload if kind == "response" else None


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, data, parts = zlib.decompressobj(31), b"", []
    while data or (data := stream.read(1 << 20)):
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def _read(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    files, root = _filesystem(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, held = [], 0
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in members(stream):
                    rows.append(parse(data))
                    held += len(data)
                    if held > 1 << 23:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files that the manifest lists; revisits carry no payload."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    n = max(1, manifest.count())
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    )
    # One file a partition, up to a few thousand tasks; a manifest has one short row per file.
    dealt = manifest.select("file").repartition(min(n, 4096))
    return dealt.mapInArrow(partial(_read, folder=folder, schema=schema), _READ)
