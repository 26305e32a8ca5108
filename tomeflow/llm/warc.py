"""Dictionary-compressed WARC: one Zstandard dictionary per archive, records compressed one by one.

An archive (``.warc.zst``) starts with a skippable frame that holds its dictionary, trained on a bounded sample of its own
records; every record is a frame of its own, so any record can be read with the dictionary alone. A payload met before is
a revisit record that names the first page with that payload and holds no payload itself.

Tasks write archives of about ``ARCHIVE_BYTES`` to a shared folder under names of their own and return them as rows; only
names that a finished task returned are read, so lost or repeated tasks leave nothing that counts.

Defined cases: a null html is an empty payload; a null url has no target line; equal payloads of ``least_bytes`` or more
become revisits of the smallest page id among them, those of rows without an id too; rows that repeat the id and payload of
the smallest page are responses each; an empty table has no archives and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut_lineage, fresh_folder

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 200_000
# Fixed values of the format: the magic of a dictionary's skippable frame, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to). Payloads are hashed where they are; only digests are shuffled to find repeats."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    digest = F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload"))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key"), digest.alias("_digest"), "page_id")
    firsts = narrow.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and refers_to is not null").drop("_n")
    # Few digests repeat; a hot one has one row here.
    later = narrow.join(firsts, "_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("_key", "_digest", "refers_to").distinct()
    later = cut_lineage(later)
    if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    keyed = rows.withColumn("_key", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("_digest", digest)
    return keyed.join(later, ["_key", "_digest"], "left").select("page_id", "url", "payload", "refers_to")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: " + _record_id(page_id).encode(), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url).encode("utf-8", "surrogatepass"))
    if page_id is not None:
        head.append(b"WARC-Page-ID: %d" % page_id)
    head += [b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(), b"WARC-Payload-Length: %d" % len(payload)]
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE.encode(), b"WARC-Refers-To: " + _record_id(refers_to).encode(), b"WARC-Refers-To-Page-ID: %d" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES):
    """A dictionary from records spread over the archive, at most ``sample_bytes`` of them."""
    import zstandard as zstd

    held = sum(map(len, records))
    step = max(1, -(-held // sample_bytes))
    sample = records[::step]
    try:
        return zstd.train_dictionary(min(size, max(256, sum(map(len, sample)) // 8)), sample)
    except zstd.ZstdError:
        # Too few records to train on: their bytes are the dictionary.
        return zstd.ZstdCompressionDict(b"".join(sample)[-size:].rjust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[int]]:
    """(bytes of the archive, offset of each record's frame)."""
    import zstandard as zstd

    d = dictionary(records)
    raw = d.as_bytes()
    out, offsets = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw], []
    at = 8 + len(raw)
    compressor = zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    for r in records:
        offsets.append(at)
        out.append(compressor.compress(r))
        at += len(out[-1])
    return b"".join(out), offsets


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    import zstandard as zstd

    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    d = zstd.ZstdCompressionDict(content[8:8 + size])
    with zstd.ZstdDecompressor(dict_data=d).stream_reader(memoryview(content)[8 + size:], read_across_frames=True) as reader:
        data = reader.read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not at the start of a record")
        head = dict(x.split(": ", 1) for x in lines)
        start, n = end + 4, int(head["Content-Length"])
        if data[start + n:start + n + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")
        yield head, data[start:start + n]
        at = start + n + 4


def _store(folder: str, name: str, content: bytes) -> None:
    """Write one file to a folder given as a path or URI, complete under its name or not at all."""
    from pyarrow import fs

    root = folder.replace("s3a://", "s3://", 1)
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    system, base = (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}.tmp") as f:
        f.write(content)
    system.move(f"{base}/{name}.tmp", f"{base}/{name}")


def _write(folder: str, limit: int):
    schema = pa.schema([("name", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            content, _ = archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            _store(folder, name, content)
            return pa.record_batch([[name], [len(held)], [size], [len(content)]], schema=schema)

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                held.append(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py()))
                size += len(held[-1])
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """(folder, manifest): writes every page; the manifest (name, records, raw_bytes, bytes) lists the archives that count."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    rows = with_first(pages, least_bytes)
    return folder, cut_lineage(rows.mapInArrow(_write(folder, archive_bytes), "name string, records long, raw_bytes long, bytes long"))


def _parse(with_payload: bool):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + ([("payload", pa.binary())] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in records_of(content.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
                    page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                    rows.append((None if page is None else int(page), head.get("WARC-Target-URI"), size, digest, kind, None if refers is None else int(refers), payload if kind == "response" else None))
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def read(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of all records of the archives that the manifest lists, each response checked against its digest."""
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], _read_schema(with_payload))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    names = manifest.select("name")
    small = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    counted = named.join(F.broadcast(names) if small else names, "name", "left_semi")
    return counted.select("content").mapInArrow(_parse(with_payload), _read_schema(with_payload))


def _read_schema(with_payload: bool) -> str:
    return "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
