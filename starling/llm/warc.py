"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, and
a skippable last frame with the sizes of all frames (the public seekable format),
so any reader of Zstandard can read it and this one can go to a frame directly. An
index maps each record to its bundle, frame and offset inside the frame.

Payloads that were stored before are not stored again: the record with the
smallest page id is the response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.llm.common import bounded_broadcast, fresh_path, store

#: Bytes of records, before compression, after which a frame and a bundle end; a longer record is a frame of its own.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Frames that one read task takes at a time.
FRAMES_A_UNIT = 16
#: Payloads shorter than this are always stored.
LEAST_REVISIT = 100
#: Repeated payloads, as digest and id, that may be broadcast; beyond, a shuffled join does it.
BROADCAST_ROWS = 200_000

# Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RESULT_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id) -> str:
    return "" if page_id is None else str(page_id)


def build_record(record_id: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; refers_to makes it a revisit, which names the length of the payload it leaves out."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Page-ID", _urn(page_id))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[start:stop], stop + 4


class BundleWriter:
    """Appends records to a bundle; add() tells the frame and the offset of each."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int]] = []
        self.open, self.size, self.total = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.end_frame()
        place = (len(self.frames), self.size)
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)
        return place

    def end_frame(self) -> None:
        if self.open:
            packed = self.pack(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the file has no seek table")
        width = 12 if flags & 0x80 else 8
        file.seek(size - 9 - width * count)
        table = file.read(width * count)
        self.place, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.place.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        import zstandard

        at, packed, plain = self.place[number]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]


def open_store(uri: str):
    """pyarrow's file system and path for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses). Only digests and ids are grouped, never payloads."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = store(groups.where("n > 1 and first_id is not null").select("digest", "first_id"), "warc-repeated")
    joined = rows.join(bounded_broadcast(repeated, BROADCAST_ROWS), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_bundles(marked: DataFrame, folder: str) -> DataFrame:
    """Writes bundles into a shared folder and returns the index of their records, itself a written table.

    A bundle's name is new for each attempt of a task; the index holds those of the attempts that Spark took."""

    def write(batches):
        import contextlib

        files, path = open_store(folder)
        writer, name, index, n = None, "", [], 0

        def flush():
            cols = list(zip(*index)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])

        with contextlib.ExitStack() as undo:
            for batch in batches:
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(files.open_output_stream(f"{path}/{name}", compression=None))
                        undo.callback(writer.out.close)
                    record_id = f"{name[:32]}-{n}"
                    record = build_record(record_id, page_id, url, payload, digest, refers)
                    frame, offset = writer.add(record)
                    index.append((record_id, page_id, name, frame, offset, len(record)))
                    n += 1
                    if writer.total >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                if writer is None or len(index) >= 10_000:
                    yield flush()
                    index = []
            if writer is not None:
                writer.close()
            if index:
                yield flush()

    files, path = open_store(folder)
    files.create_dir(path, recursive=True)
    return store(marked.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """A row per record of the bundles that the index names: RESULT_SCHEMA, the digest of a response computed from its payload."""

    def read(batches):
        files, path = open_store(folder)
        for batch in batches:
            for name, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with files.open_input_file(f"{path}/{name}") as f:
                    bundle = BundleReader(f)
                    for number in range(unit * FRAMES_A_UNIT, min((unit + 1) * FRAMES_A_UNIT, len(bundle.place))):
                        data, at = bundle.frame(number), 0
                        while at < len(data):
                            fields, block, at = parse_record(data, at)
                            payload, digest = block[len(HTTP_HEAD) :], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            if fields["WARC-Type"] == "response" and (found := hashlib.sha256(payload).hexdigest()) != digest:
                                raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest is {found}")
                            page, first = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
                            rows.append((int(page) if page else None, int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], int(first) if first else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

    units = store(index.select("bundle", F.floor(F.col("frame") / FRAMES_A_UNIT).cast("int").alias("unit")).distinct(), "warc-units")
    n = max(1, min(units.count(), 10_000))  # one unit a task or so, whatever the bytes of this short list
    return units.repartition(n, "bundle", "unit").mapInArrow(read, RESULT_SCHEMA)


def fetch(index: DataFrame, folder: str, record_ids: list[str]) -> dict[str, bytes]:
    """Payloads of single records, each read through its frame alone; a revisit gives b''."""
    files, path = open_store(folder)
    out = {}
    for r in index.where(F.col("record_id").isin(record_ids)).collect():
        with files.open_input_file(f"{path}/{r['bundle']}") as f:
            out[r["record_id"]] = BundleReader(f).record(r["frame"], r["offset"])[1][len(HTTP_HEAD) :]
    return out


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Writes all pages and reads them back: (the rows read, the index).

    A null html is an empty payload, which like any under 100 bytes is stored
    always. Rows that repeat the smallest id of a payload are all responses; a row
    with a null id revisits if any row of its payload has an id, else it is a
    response. An empty table gives no bundle and no rows. Columns beyond the three
    named are ignored."""
    folder = folder or fresh_path(spark, "warc-bundles")
    index = write_bundles(mark_revisits(pages, id_col, url_col, html_col), folder)
    return read_bundles(index, folder), index
