"""WARC archives compressed by Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: page ids of equal payloads are resolved by an aggregation over digests; each task writes one archive of a
bounded size through Spark's text writer, whose line separator is an empty skippable frame, so any file
system of Spark's will do and lost tasks are simply written again. Reading: Spark's binaryFile source gives whole
archives; a task decodes them frame by frame.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm.batches import slices
from storepulse.plans.lineage import cut

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
WARC_VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"


def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def trained_dictionary(samples: list[bytes], size: int):
    """A dictionary of at most `size` bytes from the samples; from too few or too small ones, their own bytes; None without any."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, MemoryError):
        raw = b"".join(samples)[:size]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP head, with the full payload's length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    name = "" if page_id is None else page_id
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return WARC_VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def resolve_revisits(pages: DataFrame, least_bytes: int = 1000, hubs: int = 4096) -> DataFrame:
    """page_id, refers_to of the pages whose payload (least_bytes or more) a page with a larger id has too.

    Only digests and ids are shuffled; the groups are aggregates, never lists. A digest with over 1 / hubs of the rows, of which there are
    at most `hubs`, is looked up from a broadcast, so that no group of copies meets in one task. Null ids give none; an empty table gives none."""
    sized = cut(pages.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("digest")), "digests")
    last = sized.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("n")).filter("least < refers_to")
    floor = sized.count() / hubs
    marked = sized.join(F.broadcast(last.filter(F.col("n") > floor).select("digest", F.col("refers_to").alias("of_hub"))), "digest", "left")
    rest = marked.filter("of_hub IS NULL").select("page_id", "digest").join(last.filter(F.col("n") <= floor).select("digest", "refers_to"), "digest")
    both = marked.filter("of_hub IS NOT NULL").select("page_id", F.col("of_hub").alias("refers_to")).union(rest.select("page_id", "refers_to"))
    return both.filter("page_id < refers_to").distinct()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 16 << 20, dictionary_bytes: int = 1 << 15, level: int = 3, least_bytes: int = 1000) -> None:
    """One record per row of pages, in archives of about archive_bytes of payload, under path.

    Of rows with equal payloads of at least least_bytes, those with the largest page_id are responses and the others revisits.
    Rows without page_id are responses. Each archive's dictionary is trained on its own first records (8 MB at most)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("n")).first().n
    archives = max(1, math.ceil(total / archive_bytes))
    revisits = resolve_revisits(rows, least_bytes).withColumnRenamed("page_id", "of")
    # the id of a page without one is drawn, so that such pages do not meet in one task
    spread = rows.withColumn("key", F.coalesce("page_id", -F.abs(F.xxhash64(F.monotonically_increasing_id())) - 1))
    # both sides dealt alike, so that the payloads are shuffled once
    named = spread.repartition(archives, "key").join(revisits.withColumnRenamed("of", "key").repartition(archives, "key"), "key", "left").withColumn("digest", F.sha1("payload"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for part in slices(batches, "payload"):
                for row in part.select(["page_id", "url", "payload", "digest", "refers_to"]).to_pylist():
                    short = row["refers_to"] is not None and len(row["payload"]) >= least_bytes and row["page_id"] < row["refers_to"]
                    yield record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], short)

        def told(frames: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

        first, held, source = [], 0, records()
        for one in source:
            first.append(one)
            held += len(one)
            if held >= 8 << 20:
                break
        if not first:
            return
        dictionary = trained_dictionary([x[: 1 << 16] for x in first], dictionary_bytes)
        press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        yield told([skippable(dictionary.as_bytes() if dictionary else b"")])
        yield told([press.compress(x) for x in first])
        frames, size = [], 0
        for one in source:
            frames.append(press.compress(one))
            size += len(frames[-1])
            if size > 1 << 20:
                yield told(frames)
                frames, size = [], 0
        if frames:
            yield told(frames)

    frames = named.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", SEPARATOR).text(path)


class BadArchive(ValueError):
    """An archive that breaks the format: a bad magic, a cut frame, a wrong length or digest."""


def frames_of(data: bytes) -> Iterator[bytes]:
    """The records of one archive: its leading skippable frame is the dictionary, each later frame is one record."""
    import zstandard

    view, at, reader, leading = memoryview(data), 0, None, True
    while at < len(view):
        if at + 4 > len(view):
            raise BadArchive("a cut frame")
        (magic,) = struct.unpack_from("<I", view, at)
        if magic in SKIPPABLE_MAGICS:
            if at + 8 > len(view):
                raise BadArchive("a cut skippable frame")
            (size,) = struct.unpack_from("<I", view, at + 4)
            if at + 8 + size > len(view):
                raise BadArchive("a cut skippable frame")
            if leading and magic == DICTIONARY_MAGIC and size:
                content = bytes(view[at + 8 : at + 8 + size])
                if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    content = zstandard.ZstdDecompressor().decompress(content)
                kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
            leading = False
            at += 8 + size
            continue
        leading = False
        reader = reader or zstandard.ZstdDecompressor()
        one, parts = reader.decompressobj(), []
        while not one.eof:
            chunk = view[at : at + (1 << 14)]
            if not len(chunk):
                raise BadArchive("a cut frame")
            try:
                parts.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """The fields of one record; BadArchive if a header or a length is not as it must be."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(line.partition(": ")[::2] for line in lines)
    if not gap or first.encode() != WARC_VERSION:
        raise BadArchive(f"no WARC header: {first[:40]!r}")
    missing = [k for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length") if not headers.get(k)]
    if missing or not headers["Content-Length"].isdigit():
        raise BadArchive(f"headers missing or bad: {missing or headers['Content-Length']}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {size}, but {len(rest) - 4} bytes")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if not gap or not length:
        raise BadArchive("no HTTP header")
    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response":
        import hashlib

        if len(payload) != int(length[1]) or hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive("the payload has another length or digest")
    elif kind != "revisit" or payload or not headers.get("WARC-Refers-To"):
        raise BadArchive(f"a {kind} record that is not as it must be")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))) else None
    return {"page_id": number("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "payload_bytes": int(length[1]), "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits).

    Every record is decoded whole and validated; a bad one fails the job with BadArchive."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0

                def told():
                    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

                for data in frames_of(batch.column("content")[i].as_py()):
                    rows.append(parse_record(data))
                    size += len(data)
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield told()
                        rows, size = [], 0
                if rows:
                    yield told()

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)
