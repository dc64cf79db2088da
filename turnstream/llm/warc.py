"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, and a last skippable frame with
the seek table of the public seekable format (sizes of each frame).  An index maps each record id to its
bundle, frame and offset in the frame's decompressed bytes, so one record is read by one seek and one frame.

Tasks write bundles under names of their own and report them as rows; the rows of the attempt that Spark
commits name the bundles that count, so a lost executor or a repeated task leaves at most an unnamed file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import open_store, qualified, write_file
from .common import SHARE, materialize, possibly_in, scratch

#: Payloads shorter than this are never replaced by a revisit record.
LEAST_REVISIT = 1000
#: Decompressed bytes of records in a frame, and of a bundle, at which the next begins.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20

# fixed values: the seekable format of Zstandard, and WARC
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "record_id string, page_id long, bundle string, frame int, frame_at long, frame_size int, offset int, length int"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame of an open bundle."""
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - count * width)
    table, at, out = f.read(count * width), 0, []
    for i in range(count):
        c, d = struct.unpack_from("<II", table, i * width)
        out.append((at, c, d))
        at += c
    return out


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, record_id: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode('ascii')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's end is not where its length says")
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if fields.get(k, "").strip() else None
    return {
        "page_id": number("X-Page-ID"),
        "record_type": fields["WARC-Type"],
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload_bytes": number("X-Payload-Length"),
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload,
    }


class _Bundle:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.packer = zstandard.ZstdCompressor(level=3)
        self.body, self.frames, self.rows = bytearray(), [], []
        self.open, self.here = bytearray(), []
        self.size = 0

    def add(self, record_id: str, page_id: int | None, record: bytes) -> None:
        self.here.append((record_id, page_id, len(self.open), len(record)))
        self.open += record
        self.size += len(record)
        if len(self.open) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.here:
            return
        packed = self.packer.compress(bytes(self.open))
        self.rows += [(r, p, self.path, len(self.frames), len(self.body), len(packed), o, n) for r, p, o, n in self.here]
        self.frames.append((len(packed), len(self.open)))
        self.body += packed
        self.open, self.here = bytearray(), []

    def finish(self) -> list[tuple]:
        self.end_frame()
        if self.rows:
            write_file(self.path, bytes(self.body) + seek_table(self.frames))
        return self.rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundle(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                payload = (html or "").encode()
                record_id = str(uuid.uuid4())
                bundle.add(record_id, page_id, build_record(page_id, url, payload, digest, refers, record_id))
                if bundle.size >= BUNDLE_BYTES:
                    yield _index_batch(bundle.finish())
                    bundle = _Bundle(folder)
        if rows := bundle.finish():
            yield _index_batch(rows)

    return write


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to: of equal payloads of LEAST_REVISIT bytes or more, the largest page_id is the original.

    Originals are found from ids and digests alone.  Pages meet those of frequent payloads where they are read, as at
    most SHARE of them are; of all others only those that share a cell with a repeated payload are shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    ids = materialize(rows.where(F.col("bytes") >= LEAST_REVISIT).select("page_id", "digest"), "payloads")
    originals = ids.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    originals = materialize(originals, "originals")
    heavy = F.col("n") * SHARE > ids.count()
    often, rare = F.broadcast(originals.where(heavy).drop("n")), originals.where(~heavy).drop("n")
    hot = rows.join(often, "digest")
    cold = rows.join(often.select("digest"), "digest", "left_anti")
    met = possibly_in(cold, "digest", rare, "digest").join(rare, "digest", "left")
    alone = possibly_in(cold, "digest", rare, "digest", "left_anti").withColumn("original", F.lit(None).cast("long"))
    joined = hot.unionByName(met).unionByName(alone)
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages into bundles under folder; returns the index, one row per record.

    pages: page_id, url, html and any other columns; a null html is an empty payload.  Rows that repeat the
    original's page_id and payload are all responses.  The index is kept as Parquet in folder/index.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    index = plan_records(pages).mapInArrow(_writer(f"{folder}/bundles"), INDEX)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_record(bundle: str, frame_at: int, frame_size: int, offset: int, length: int) -> dict:
    """One record by its index row: one seek, one frame."""
    fs, where = open_store(bundle)
    with fs.open_input_file(where) as f:
        f.seek(frame_at)
        return parse_record(zstandard.ZstdDecompressor().decompress(f.read(frame_size))[offset : offset + length])


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame int, offset int"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            fs, where = open_store(row["bundle"])
            with fs.open_input_file(where) as f:
                start, packed, plain = read_seek_table(f, f.size())[row["frame"]]
                f.seek(start)
                raw = unpack.decompress(f.read(packed), max_output_size=plain)
            out = []
            for x in row["records"]:
                rec = parse_record(raw[x["offset"] : x["offset"] + x["length"]])
                if rec["record_type"] == "response" and (hashlib.sha1(rec["payload"]).hexdigest() != rec["payload_digest"] or len(rec["payload"]) != rec["payload_bytes"]):
                    raise ValueError(f"record {x['record_id']} is damaged")
                out.append((rec["page_id"], rec["payload_bytes"], rec["payload_digest"], rec["record_type"], rec["refers_to"], x["record_id"], row["bundle"], row["frame"], x["offset"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def read_bundles(index: DataFrame) -> DataFrame:
    """Every indexed record, read back from its bundle's frame and checked against its digest.

    A frame is one row of work; it holds about FRAME_BYTES of records, so its list of records is bounded.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_id", "offset", "length")).alias("records"))
    return frames.mapInArrow(_reader, READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as bundles and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to and the record's place."""
    return read_bundles(write_bundles(pages, folder or scratch(pages.sparkSession, "warc")))
