"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent frames, each with some whole records, and a last skippable frame with the seek table:
each frame's compressed and uncompressed length, the number of frames, and a magic number.  An index table maps every
record to its bundle, frame and offset in the frame, so that one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.llm.common import shared_dir, small_batches, stored

# Fixed values of the seekable format: skippable frame, and end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame_at long, frame_bytes long, record_at long, record_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are twenty bits, which are four base32 digits."""
    hexed = F.sha1(text)
    part = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is null for what is stored in full."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), digest_of(html).alias("payload_digest"))
    # Stored, so that the join sees plain shuffles and can split the partition of a very common payload.
    first = stored(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first")))
    joined = rows.join(first, "payload_digest", "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple]:
    """The records of a decompressed frame, each checked against its digest."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in frame[at:body].decode().split("\r\n")[1:] if x)
        block = frame[body : body + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        page, to = (int(v) if (v := head.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
        if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of page {page} doesn't match its digest")
        yield page, head.get("WARC-Target-URI"), head["WARC-Type"], to, size, digest, payload
        at = body + len(block) + 4


class BundleWriter:
    """Writes one bundle; add() gives nothing back, rows() the index rows once closed."""

    def __init__(self, folder: str, frame_bytes: int):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path)
        # A name of its own for every attempt: a retried task leaves an orphan, never a file that half belongs to it.
        self.name, self.frame_bytes = f"{uuid.uuid4().hex}.warc.zst", frame_bytes
        self.out, self.zstd = self.fs.open_output_stream(f"{path}/{self.name}", compression=None), zstandard.ZstdCompressor(level=3)
        self.at, self.sizes, self.open, self.pending, self.index = 0, [], bytearray(), [], []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.pending.append((page_id, len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(bytes(self.open))
            self.out.write(packed)
            self.index += [(page, self.name, self.at, len(packed), at, size) for page, at, size in self.pending]
            self.sizes.append((len(packed), len(self.open)))
            self.at, self.open, self.pending = self.at + len(packed), bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.index


def frames(source) -> Iterator[bytes]:
    """The decompressed frames of an open bundle, found by its seek table alone."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
    source.seek(0)
    for packed, size in sizes:
        yield zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26) -> DataFrame:
    """Writes pages (page_id, url, html) to bundles in folder, a URI that all executors share, and returns the index.

    Null html is empty.  Of equal payloads of at least min_bytes, the smallest page_id is a response and others are
    revisits of it; rows that repeat that id are responses too, as are rows without id while no row of theirs has one.
    A frame closes at frame_bytes of records and a bundle at bundle_bytes; a larger record has a frame of its own.
    Further columns are ignored.  An empty table writes no bundle.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for b in batches:
            done = []
            for page, url, html, size, digest, to in b.itertuples(index=False):
                page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                writer = writer or BundleWriter(folder, frame_bytes)
                writer.add(page, record(page, url, html.encode("utf-8", "surrogatepass"), int(size), digest, to))
                if writer.at >= bundle_bytes:
                    done, writer = done + writer.close(), None
            yield index_rows(done)
        if writer:
            yield index_rows(writer.close())

    return stored(with_revisits(pages, min_bytes).mapInPandas(run, INDEX))


def index_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64"})


def record_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the index's bundles, in RECORD's columns, read frame by frame by the bundles' seek tables.

    Bundles are dealt over as many tasks as there are bundles.  An empty index gives no record.
    """
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))  # by a key, the plan would keep the few tasks of distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b["bundle"]:
                with fs.open_input_file(f"{path}/{name}") as source:
                    for frame in frames(source):
                        yield record_rows([(*r[:6], r[6] if payloads else None) for r in records(frame)])

    return bundles.mapInPandas(run, RECORD)


def fetch_records(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records with a page_id in ids, each from its own frame by offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for (name, at, size), rows in b.groupby(["bundle", "frame_at", "frame_bytes"]):
                with fs.open_input_file(f"{path}/{name}") as source:
                    source.seek(int(at))
                    packed = source.read(int(size))
                frame = zstandard.ZstdDecompressor().decompress(packed, max_output_size=zstandard.frame_content_size(packed))
                yield record_rows([next(records(frame[r.record_at : r.record_at + r.record_bytes])) for r in rows.itertuples()])

    return index.join(ids.select("page_id").distinct(), "page_id", "left_semi").mapInPandas(run, RECORD)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
