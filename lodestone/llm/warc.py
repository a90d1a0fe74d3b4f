"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is its frames and then a seek table in a skippable
frame, as in the public seekable format. An index maps each record identifier to its frame and the offset inside the frame, so
one record is read by decompressing one frame. Bundles are rows of a Parquet table (archive bytes and index) in the shared
folder, written with Spark's commit protocol; `export` puts them into files of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, ship, small, stage, staging_path

#: Bytes of records, before compression, at which a frame and a bundle are closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
LEAST_SHARED = 100
#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lodestone:page:"
BUNDLES = "bundle string, archive binary, records array<struct<record_id: string, frame: int, offset: int, length: int>>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit names the response and holds the digest of the payload, not the payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>"]
    if url:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; payload of a revisit: empty."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda k: int(fields[k][len(_URN) + 1 : -1]) if len(fields.get(k, "")) > len(_URN) + 2 else None
    return {"type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": number("WARC-Refers-To"), "payload": body[: int(fields["Content-Length"])]}


def pack(frames: list[bytes], level: int = 3) -> bytes:
    """Frames and their seek table."""
    compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    packed = [compress(f) for f in frames]
    entries = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames, strict=True))
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed length, length) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at = len(archive) - 9 - n * width
    out, start = [], 0
    for i in range(n):
        packed, length = struct.unpack_from("<II", archive, at + i * width)
        out.append((start, packed, length))
        start += packed
    return out


def frame(archive: bytes, table: list[tuple[int, int, int]], i: int) -> bytes:
    start, packed, length = table[i]
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=length)


def assign(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: null for responses, for a repeat of a payload of LEAST_SHARED bytes or more the least page_id with it.

    Only payloads that occur more than once are joined: by broadcast if they are few, else by shuffle, where Spark splits a hot digest."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    light = p.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    first = stage(first, "payloads")
    digest = F.when(F.octet_length("html") >= LEAST_SHARED, F.sha2(F.col("html").cast("binary"), 256))
    known = p.withColumn("digest", digest).join(small(first, 120), "digest", "left")
    return known.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def bundles(assigned: DataFrame) -> DataFrame:
    """bundle, archive, records of the pages of assign(). A task holds one bundle at a time."""
    ship(assigned.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        frames: list[list[bytes]] = [[]]
        index: list[dict] = []
        whole = inside = 0

        def close() -> pa.RecordBatch:
            nonlocal frames, index, whole, inside, made
            row = {"bundle": [f"{part:06d}-{made:06d}"], "archive": [pack([b"".join(f) for f in frames if f])], "records": [index]}
            frames, index, whole, inside, made = [[]], [], 0, 0, made + 1
            kind = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
            return pa.RecordBatch.from_pydict(row, schema=kind)

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id = page_id.as_py()
                data = record(page_id, url.as_py(), html.as_py().encode(), refers.as_py())
                index.append({"record_id": f"{_URN}{'' if page_id is None else page_id}", "frame": len(frames) - 1, "offset": inside, "length": len(data)})
                frames[-1].append(data)
                inside += len(data)
                whole += len(data)
                if whole >= BUNDLE_BYTES:
                    yield close()
                elif inside >= FRAME_BYTES:
                    frames.append([])
                    inside = 0
        if index:
            yield close()

    return assigned.select("page_id", "url", "html", "refers_to").mapInArrow(write, BUNDLES)


def read(archives: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest, payload of every record; frames are found by the seek table, records by the index.

    The payload of a revisit is null (its response has it). A payload that does not have its digest raises an error."""
    ship(archives.sparkSession)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(batch.column("archive"), batch.column("records"), strict=True):
                archive, by = archive.as_py(), {}
                table = seek_table(archive)
                for r in records.as_py():
                    by.setdefault(r["frame"], []).append((r["offset"], r["length"]))
                for i, places in by.items():
                    data = frame(archive, table, i)
                    got = [parse(data[o : o + n]) for o, n in places]
                    for r in got:
                        if r["type"] == "response" and hashlib.sha256(r["payload"]).hexdigest() != r["digest"]:
                            raise ValueError(f"page {r['page_id']}: the payload is not that of the digest")
                    yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in got], pa.int64()), pa.array([r["type"] for r in got]), pa.array([r["refers_to"] for r in got], pa.int64()), pa.array([r["digest"] for r in got]), pa.array([r["payload"] if r["type"] == "response" else None for r in got], pa.binary())], ["page_id", "record_type", "refers_to", "digest", "payload"])

    return archives.select("archive", "records").mapInArrow(take, "page_id long, record_type string, refers_to long, digest string, payload binary")


def lookup(archives: DataFrame, page_ids: list[int]) -> DataFrame:
    """page_id, payload of the responses among a few pages, one row for each record; only the frames that hold them are decompressed.

    Pages that are not there, and revisits, give no row; an empty list gives none."""
    wanted = {f"{_URN}{p}" for p in page_ids}
    hit = archives.withColumn("records", F.filter("records", lambda r: r["record_id"].isin(*wanted))).filter(F.size("records") > 0)
    return read(hit).filter("record_type = 'response'").select("page_id", "payload")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to <folder>/<bundle>.warc.zst and its record index to <folder>/<bundle>.json beside it, where folder is mounted
    by all executors; returns bundle, path. Files appear whole, by renaming. A table without bundles writes nothing."""
    ship(archives.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = batch.column("bundle").to_pylist()
            paths = [os.path.join(folder, f"{n}.warc.zst") for n in names]
            for path, data, records in zip(paths, batch.column("archive"), batch.column("records"), strict=True):
                places = {r["record_id"]: [r["frame"], r["offset"], r["length"]] for r in records.as_py()}
                for to, content in ((path.removesuffix(".warc.zst") + ".json", json.dumps(places).encode()), (path, data.as_py())):
                    own = f"{to}.{TaskContext.get().taskAttemptId()}"
                    with open(own, "wb") as f:
                        f.write(content)
                    os.replace(own, to)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(paths)], ["bundle", "path"])

    return archives.select("bundle", "archive", "records").mapInArrow(put, "bundle string, path string")


def write(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """The archives of pages, written to path (or the shared folder) and read again as a table."""
    path = path or staging_path(spark, "archives")
    bundles(assign(pages)).write.parquet(path)
    return spark.read.schema(BUNDLES).parquet(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives of pages.

    A null html is an empty payload. A null page_id is never a response that others refer to, unless no row of the payload has an id;
    then all are responses. Rows with equal page_id and payload are each a response. Other columns are not read."""
    records = stage(read(write(pages.sparkSession, pages)).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes")), "records")
    # A revisit's payload is its response's: by page and digest. However many revisit one payload, they are dealt to many tasks.
    names = lambda page: F.concat_ws(":", page, "digest").alias("of")
    again = records.filter("record_type = 'revisit'").select("*", names("refers_to"))
    asked = again.select("of").distinct()
    full = stage(records.filter("record_type = 'response'").select(names("page_id"), F.col("bytes").alias("whole")).join(asked, "of", "left_semi").distinct(), "responses")
    again = join_unique(again, full, "of", 120 * full.count())
    out = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return records.filter("record_type = 'response'").withColumn("payload_bytes", F.col("bytes")).select(*out).unionByName(again.withColumn("payload_bytes", F.col("whole")).select(*out))
