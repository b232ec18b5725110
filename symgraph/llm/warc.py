"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle is a file of frames with a
seek table, in the seekable format, as a skippable frame at its end.  An index maps each record to its
bundle, frame and the offset in the unpacked frame, so a record is read by unpacking one frame.

Of equal payloads of ``LEAST`` bytes or more, the one with the greatest id is a response and the others are
revisits that refer to it; a revisit's block holds the HTTP headers only.

A task writes its bundles under names of its own and reports them in the index.  The index is a Spark table,
so it only has what finished tasks wrote, and readers only open bundles that it names: a task that runs
again after a lost executor can't leave records twice.

Defined results: a null html is an empty payload; a null url has no Target-URI; a null id is written as
``none`` and is the least of ids; rows with equal ids and payloads are written alike; an empty table makes
no bundle; further columns are ignored.
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

from .scratch import materialize, new_path

LEAST = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, with the blank lines after it.  ``digest`` is the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record from ``at`` on."""
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


class Bundle:
    """Collects records into frames; ``close`` gives the file's bytes."""

    def __init__(self, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset inside it at which a record is put."""
        if self.open_bytes >= FRAME_BYTES:
            self._flush()
        place = (len(self.frames), self.open_bytes)
        self.open.append(data)
        self.open_bytes += len(data)
        self.bytes += len(data)
        return place

    def _flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append(self.pack(raw))
            self.sizes.append((len(self.frames[-1]), len(raw)))
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of each frame of a bundle."""
    count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    start, out = 0, []
    for k in range(count):
        packed, raw = struct.unpack_from("<II", data, len(data) - 9 - 8 * (count - k))
        out.append((start, packed, raw))
        start += packed
    return out


def frame(data: bytes, number: int) -> bytes:
    """One frame of a bundle, unpacked; nothing else of it is."""
    start, packed, raw = seek_table(data)[number]
    return _unpacked(data[start : start + packed], raw)


def _unpacked(packed: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)


def frames(file, size: int, wanted: list[int]) -> Iterator[bytes]:
    """Frames of an open bundle of ``size`` bytes; its seek table and these frames are read, and nothing else."""
    file.seek(size - 9)
    count, _, _ = struct.unpack("<IBI", file.read(9))
    file.seek(size - 9 - 8 * count)
    table = seek_table(file.read(8 * count + 9))
    for number in wanted:
        start, packed, raw = table[number]
        file.seek(start)
        yield _unpacked(file.read(packed), raw)


def read_record(data: bytes, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    return next(parse(frame(data, number), offset))


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the rows that are revisits."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), _payload().alias("p")).select(
        "page_id", F.sha1("p").alias("digest"), F.octet_length("p").alias("size")
    )
    rows = rows.filter(F.col("size") >= least).select("page_id", "digest")
    kept = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    same = rows.join(kept.select("digest", "refers_to"), "digest")
    return same.filter("page_id IS NULL OR page_id < refers_to").filter("refers_to IS NOT NULL").distinct()


def _payload():
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


_INDEX = "record_id string, page_id bigint, bundle string, frame bigint, offset bigint, length bigint"


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[str, DataFrame]:
    """Writes bundles to ``folder`` (new, in the shared folder, if none is given); returns it and the index."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        bundle, name, rows = None, "", []

        def done() -> pa.RecordBatch:
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(bundle.close())
            names = [x.split(" ")[0] for x in _INDEX.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                page, url, payload, digest, refers = (c[k].as_py() for c in columns)
                if bundle is None:
                    bundle, name, rows = Bundle(), f"{uuid.uuid4().hex}.warc.zst", []
                    store.create_dir(root, recursive=True)
                data = record(page, url, payload, digest, refers, refers is not None)
                at = bundle.add(data)
                rows.append((record_id(page), page, name, *at, len(data)))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    html = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    html = html.withColumn("digest", F.sha1("payload"))
    back = materialize(decide(pages, least), "revisits").withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d")
    joined = html.join(back, html["page_id"].eqNullSafe(back["p"]) & (html["digest"] == back["d"]), "left")
    made = joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, _INDEX)
    return folder, materialize(made, "warc-index")


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the bundles.

    Tasks open the bundles that the index names and read the frames that it names.  Payloads that are there
    are hashed, and must have the digest that their record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, wanted in zip(batch.column("bundle").to_pylist(), batch.column("frames").to_pylist()):
                path = f"{root}/{bundle}"
                with store.open_input_file(path) as file:
                    for data in frames(file, file.size(), sorted(wanted)):
                        rows = []
                        for headers, block in parse(data):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            size = int(http.split(b"Content-Length: ")[1])
                            kind = headers["WARC-Type"]
                            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{headers['WARC-Record-ID']}: the payload isn't what was written")
                            refers = headers.get("WARC-Refers-To")
                            rows.append((page_of(headers["WARC-Record-ID"]), size, digest, kind, refers and page_of(refers)))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    # a bundle's frames are few, as its size is bounded; names and numbers are all that is shuffled
    named = index.groupBy("bundle").agg(F.collect_set("frame").alias("frames"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(tasks, "bundle").mapInArrow(run, schema)
