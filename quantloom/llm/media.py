"""Media columns: content-addressed payloads in tar shards, with header-only range reads for metadata.

A text becomes an 8-bit greyscale PNG, ``WIDTH`` samples wide. Each task packs its payloads in tar
shards in the shared folder, one member per digest, and emits index rows (digest, shard, offset,
length). A catalogue keeps one place per digest; features come from range reads of that place,
first of the PNG header alone, then of the whole member.

A retried task writes shards under new names; only the index rows of the attempt that Spark
accepts name a shard, so lost executors and speculation leave at most orphans.

Defined cases: null is an empty text, stored as one row of blanks; equal texts share one digest and
all values; repeated rows give repeated rows; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import open_store, shared_folder, written
from .text import in_batches, utf8

#: Samples in a row of the image, and the unit to which payloads are padded.
WIDTH = 192
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: PNG signature, and the bytes up to the end of its header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of ``WIDTH``."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b" ")


def png_of(payload: bytes, level: int = 6) -> bytes:
    """The payload as the samples of a greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """``(width, height, bit depth)`` from the first ``HEADER_BYTES`` bytes of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def payload_of(png: bytes) -> bytes:
    """The samples of a PNG made by ``png_of``."""
    width, height, _ = header_of(png[:HEADER_BYTES])
    at, data = 8, []
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if zlib.crc32(png[at + 4 : at + 8 + size]) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Image features in integers: size, mean and variance in thousandths, and a 64-bit average hash."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    n, total = a.size, int(a.sum())
    variance = (int((a * a).sum()) * n - total * total) * 1000 // (n * n)
    edges = np.linspace(0, len(a), 9).astype(int)
    rows = np.concatenate(([np.zeros(WIDTH, np.int64)], np.cumsum(a, 0)))
    cells = [(rows[max(hi, lo + 1)] - rows[lo]).reshape(8, -1).sum(1) // max(hi - lo, 1) for lo, hi in zip(np.minimum(edges[:-1], len(a) - 1), edges[1:])]
    grid = np.array(cells)
    bits = np.packbits((grid * 64 > grid.sum()).ravel()).tobytes().hex()
    return f"w={WIDTH};h={len(a)};mean={total * 1000 // n};var={variance};ahash={bits}"


def _tar_header(name: str, size: int) -> bytes:
    import tarfile

    member = tarfile.TarInfo(name)
    member.size, member.mode = size, 0o644
    return member.tobuf(tarfile.USTAR_FORMAT)


class ShardWriter:
    """Appends members to tar shards below ``root``; a digest that the shard holds isn't written again."""

    def __init__(self, root: str) -> None:
        self.store, self.path = open_store(root)
        self.store.create_dir(self.path, recursive=True)
        self.out = None

    def put(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out and digest not in self.places and self.at > SHARD_BYTES:
            self.close()
        if not self.out:
            self.name, self.at, self.places = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}")
        if digest not in self.places:
            head, pad = _tar_header(f"{digest}.png", len(media)), b"\0" * (-len(media) % 512)
            self.out.write(head + media + pad)
            self.places[digest] = (self.name, self.at + len(head), len(media))
            self.at += len(head) + len(media) + len(pad)
        return self.places[digest]

    def close(self) -> None:
        if self.out:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store_media(docs: DataFrame, root: str) -> DataFrame:
    """Writes shards below ``root``; index rows ``doc_id, n_bytes, digest, shard, offset, length``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(root)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = utf8(text)
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                known = writer.places.get(digest) if writer.out else None
                rows.append((len(data), digest, *(known or writer.put(digest, png_of(payload)))))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")


def read_media(places: DataFrame, root: str) -> DataFrame:
    """Metadata and features of each place (``digest, shard, offset, length``), from range reads below ``root``."""
    names = ["digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "digest string, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(root)
        name, shard = None, None
        for batch in batches:
            rows = []
            for digest, own, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    if shard:
                        shard.close()
                    name, shard = own, store.open_input_file(f"{path}/{own}")
                width, height, _ = header_of(shard.read_at(HEADER_BYTES, offset))
                media = shard.read_at(length, offset)
                payload = payload_of(media)
                if (got := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"payload {digest} reads back as {got}")
                rows.append((digest, width, height, len(payload), got, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores each text's payload and returns its media columns, read back from the shards."""
    root = shared_folder(docs.sparkSession, "media")
    index = written(store_media(docs, f"{root}-tar"), "media-index")
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    # a number of partitions, since index rows are too small for adaptive execution to spread their work
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = places.select("digest", "place.*").repartition(spread, "shard", F.floor(F.col("offset") / SHARD_BYTES * 64)).sortWithinPartitions("shard", "offset")
    features = read_media(places, f"{root}-tar")
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    return index.join(features, "digest").select("doc_id", *columns, "digest", "shard", "offset", "length")
