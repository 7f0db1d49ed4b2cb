"""WARC archives of zstd frames: one frame a record, the dictionary in a leading skippable frame.

Writing: a page's payload (the UTF-8 html; null counts as empty) becomes a ``response`` record;
where several pages have equal payloads, the one with the largest page id is the response and
the others are ``revisit`` records that name it and carry no payload.  Which payloads repeat is
found on digests alone; pages then meet the repeated digests in one join.

Reading: the dictionary is taken from the first frame if that is skippable, each record's frame
is found from its block headers and decoded by itself, and the record's version line, mandatory
headers, content length, HTTP length and payload digest are checked; a damaged archive raises.

Rows that repeat in full are records each; if they hold the group's largest id, all of them are
responses.  A page without an id revisits one with an id, or is a response where none has one.
An empty table makes no file and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder
from .shared_files import read_file, write_file

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
DATE = "2026-01-01T00:00:00Z"


def classify(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, n (bytes), digest (hex), keeper: the response that a page revisits."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("bigint"), "digest": F.sha1(F.col("payload").cast("binary"))})
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    repeated = materialise(groups.where("copies > 1").select("digest", "keeper"), "repeated-payloads")
    # both sides are plain scans below the join's own shuffles, so a digest of many pages can be split
    found = rows.join(repeated, "digest", "left")
    return found.withColumn("keeper", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))


def _clean(text: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, n: int, sha1: bytes, keeper: int | None) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if keeper is None else b"")
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if keeper is not None:
        lines += [f"WARC-Refers-To: <urn:page:{keeper}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], samples: int = 128, dictionary_bytes: int = 32_768, level: int = 3) -> list[bytes]:
    """The frames of an archive; the dictionary is trained on its first ``samples`` records."""
    import zstandard as zstd

    parts, dictionary = [], None
    some = [r[:16_384] for r in records[:samples]]
    if len(some) >= 16 and sum(map(len, some)) >= 16 * dictionary_bytes // 4:
        try:
            dictionary = zstd.train_dictionary(dictionary_bytes, some)
        except zstd.ZstdError:  # samples that are too alike or too short make none
            dictionary = None
    if dictionary is not None:
        raw = dictionary.as_bytes()
        parts.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    coder = zstd.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return parts + [coder.compress(r) for r in records]


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its headers alone."""
    import zstandard as zstd

    head = data[at : at + 18]
    if len(head) < 6 or struct.unpack_from("<I", head)[0] != FRAME:
        raise ValueError(f"no zstd frame at {at}")
    checksum = zstd.get_frame_parameters(head).has_checksum
    at += zstd.frame_header_size(head)
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one a frame."""
    import zstandard as zstd

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = data[8:at]
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstd.ZstdDecompressor().decompress(raw)
        dictionary = zstd.ZstdCompressionDict(raw)
    coder = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield coder.decompress(data[at:end])
        at = end


def _headers(raw: bytes, first: str) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str) -> int | None:
    if not urn.startswith("<urn:page:") or not urn.endswith(">"):
        raise ValueError(f"not a record id: {urn[:40]!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse(raw: bytes) -> dict:
    """A record's fields, after checking it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = _headers(head, "WARC/1.")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - found.keys()
    if missing:
        raise ValueError(f"a record lacks {sorted(missing)}")
    size = int(found["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n = int(_headers(http, "HTTP/")["content-length"])
    kind, digest = found["warc-type"], found.get("warc-payload-digest", "").removeprefix("sha1:")
    refers = None
    if kind == "response":
        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("a payload does not match its length and digest")
    elif kind == "revisit":
        if payload:
            raise ValueError("a revisit record has a payload")
        refers = _page(found["warc-refers-to"])
    else:
        raise ValueError(f"unknown record type {kind!r}")
    page_id = _page(found["warc-record-id"])
    return {"page_id": page_id, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 32_000_000) -> DataFrame:
    """Write .warc.zst files below ``folder``; returns their manifest (file, records)."""
    arrow = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, k = TaskContext.get(), [], 0, 0

        def flush():
            nonlocal size, k
            path = f"{folder}/pages-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.warc.zst"
            write_file(path, pack(held))
            row = pa.RecordBatch.from_pydict({"file": [path], "records": [len(held)]}, schema=arrow)
            held.clear()
            size, k = 0, k + 1
            return row

        for batch in batches:
            for page_id, url, payload, n, digest, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, payload.encode(), n, bytes.fromhex(digest), keeper))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = classify(pages, least_bytes)
    # a revisit's payload is not written, so it need not reach Python
    payload = F.when(F.col("keeper").isNull(), F.col("payload")).otherwise("").alias("payload")
    rows = rows.select("page_id", "url", payload, "n", "digest", "keeper")
    return materialise(rows.mapInArrow(write, "file string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives; with the payload if asked for."""

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    arrow = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                for raw in unpack(read_file(path)):
                    row = parse(raw)
                    rows.append(row if payloads else row | {"payload": None})
                    seen += 1
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, not {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return manifest.select("file", "records").repartition(n, "file").mapInArrow(read, schema + ", payload binary" * payloads)


def archive_rows(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_folder(spark, "warc"), least_bytes))


#: The same rows in DuckDB: the digest's 40 hex digits in groups of 5 are 4 base-32 letters each.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, 1 + CAST(floor(i / 4) AS INTEGER) * 5, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""
