"""WARC archives compressed with Zstandard and a dictionary: writer and reader.

Layout (the public .warc.zst convention): a leading skippable frame, magic 0x184D2A5D, holds the dictionary (itself a
Zstandard frame or raw); then each record is one frame of its own. The reader loads the dictionary from the leading frame,
decodes frame by frame with bounded memory, and validates: the WARC version line, Content-Length against the block, the
block digest of responses, the four closing bytes, and that nothing follows the last frame. A damaged archive raises
ValueError with the record's offset.

Payload digests are SHA-256. Of records with equal payloads of `least` bytes or more the one with the smallest id is a
response, the others are revisits that refer to it; a repeated row of that id is a response as well.

Scale: only digests and ids are shuffled to find the originals (minimum with map-side combining, and a join that AQE can
split); payloads stay in their input partitions' order until written. Each task writes archives of about `archive_bytes`
as rows of a binary column in the shared folder; `read_archives` takes such rows, or files by Spark's binaryFile source,
so neither side opens a local path. The dictionary is trained on at most `sample` payloads (those of least id hash).

Null payloads are empty. Null ids are written and come back as null. Repeated rows each get a record; an empty table gives
no rows; other columns, whatever their names, are not read. Payloads of any length are written whole (a record must stay
below 2 GiB, the limit of a binary value; a longer one raises an error); only the dictionary is trained on heads of 64 KiB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAGIC = 0x184D2A5D
LEAST = 100
ARCHIVE_BYTES = 8 << 20
SAMPLE = 400
DICTIONARY_BYTES = 64 << 10
MAX_RECORD = 1 << 31
EPOCH = "1970-01-01T00:00:00Z"  # records carry no clock, so archives are reproducible


# ---------------------------------------------------------------- records


def header_value(x: object) -> str:
    """A header value on one line: control characters and what is no ASCII are percent-encoded."""
    return "".join(chr(b) if 0x20 <= b < 0x7F else f"%{b:02X}" for b in str(x).encode("utf-8", "replace"))


def record(id_: object, uri: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One WARC 1.1 record. A revisit has an empty block and names the response that it refers to."""
    block = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:row:{'' if id_ is None else header_value(id_)}>", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {header_value(uri or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{header_value(refers_to)}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> dict:
    """Fields of a record, validated."""

    def wrong(why: str) -> ValueError:
        return ValueError(f"record at {at}: {why}")

    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise wrong("no WARC version line or no end of headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise wrong(f"bad header line {line[:40]!r}")
        fields[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise wrong(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise wrong(f"Content-Length {fields['content-length']} does not fit {len(rest) - 4} bytes")
    block = rest[:-4]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response" and digest and hashlib.sha256(block).hexdigest() != digest:
        raise wrong("the payload does not have its digest")
    return {"type": fields["warc-type"], "id": _urn(fields["warc-record-id"]), "refers_to": _urn(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri", ""), "digest": digest, "length": int(fields.get("x-payload-length", len(block))), "payload": block}


def _urn(x: str | None) -> str | None:
    return x.removeprefix("<urn:row:").removesuffix(">") or None if x else None


# ---------------------------------------------------------------- archives


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def split_leading(archive: bytes) -> tuple[bytes | None, int]:
    """(dictionary or None, where the records begin)."""
    if len(archive) < 8 or int.from_bytes(archive[:4], "little") != MAGIC:
        return None, 0
    size = int.from_bytes(archive[4:8], "little")
    body = archive[8 : 8 + size]
    if len(body) != size:
        raise ValueError("the dictionary's frame is cut off")
    if body[:4] == zstandard.MAGIC_NUMBER.to_bytes(4, "little"):
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
    return body, 8 + size


def records_of(archive: bytes) -> Iterator[dict]:
    """The validated records of an archive, one frame at a time."""
    dictionary, at = split_leading(archive)
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decoder = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        one = decoder.decompressobj()
        parts, size, here = [], 0, at
        try:
            while not one.eof and here < len(archive):
                part = one.decompress(view[here : here + (1 << 16)])
                here = min(here + (1 << 16), len(archive))
                size += len(part)
                if size > MAX_RECORD:
                    raise ValueError(f"record at {at}: more than {MAX_RECORD} bytes")
                parts.append(part)
        except zstandard.ZstdError as e:
            raise ValueError(f"record at {at}: {e}") from e
        if not one.eof:
            raise ValueError(f"record at {at}: the frame is cut off")
        yield parse(b"".join(parts), at)
        at = here - len(one.unused_data)


def train(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the payloads, or none where they are too few to train one."""
    payloads = [p for p in payloads if p]
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes() if len(payloads) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def marked(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, uri, payload binary, digest, refers_to): the first of equal payloads has no refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    light = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = light.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = light.join(first, "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, sample: int = SAMPLE) -> DataFrame:
    """(archive binary, records): whole .warc.zst archives, each with its dictionary."""
    some = pages.where(F.col(payload_col).isNotNull()).select(F.col(id_col).alias("id"), F.expr(f"substring(cast(`{payload_col}` as binary), 1, 65536)").alias("p")).orderBy(F.xxhash64("id"), "id").limit(sample)
    dictionary = train([bytes(r.p) for r in some.collect()])  # `sample` payloads at most
    trained = zstandard.ZstdCompressionDict(dictionary).as_bytes() if dictionary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        start = leading_frame(trained) if trained else b""
        parts, size, n = [start], len(start), 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([n], pa.int64())], names=["archive", "records"])

        for b in batches:
            for id_, uri, payload, digest, refers in zip(*(b.column(c) for c in ("id", "uri", "payload", "digest", "refers_to")), strict=True):
                frame = encoder.compress(record(id_.as_py(), uri.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))
                parts.append(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    yield archive()
                    parts, size, n = [start], len(start), 0
        if n:
            yield archive()

    return marked(pages, id_col, uri_col, payload_col, least).select("id", "uri", "payload", "digest", "refers_to").mapInArrow(run, "archive binary, records long")


def read_archives(archives: DataFrame, content_col: str = "archive", id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """(id, uri, payload_bytes, payload_digest, record_type, refers_to[, payload]) for each record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out: list[list] = [[] for _ in range(7)]
                for r in records_of(content.as_py() or b""):
                    for column, v in zip(out, (r["id"], r["uri"], r["length"], r["digest"], r["type"], r["refers_to"], r["payload"] if payloads else None), strict=True):
                        column.append(v)
                    if len(out[0]) >= 4096:
                        yield batch(out)
                        out = [[] for _ in range(7)]
                yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    out = archives.select(content_col).mapInArrow(run, "id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.select(F.col("id").cast(id_type), "uri", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type), *(["payload"] if payloads else []))


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    written = materialize(write_archives(pages, id_col, uri_col, payload_col, least), "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    return read_archives(written, id_type=kind).drop("uri").withColumnRenamed("id", id_col)


