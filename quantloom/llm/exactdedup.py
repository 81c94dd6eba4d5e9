"""Exact deduplication as streams with keyed state that never expires.

Tasks read texts, collapse those that are equal within reach, and append each one's bytes to a content file
of their own in the shared folder; what moves on is a row a distinct text: digest, count, largest id, and the
locator of its bytes. A streaming aggregate keyed by digest keeps, in RocksDB state on disk, the number of rows,
the id that stays and the first locator. Every later text that hits a digest is then compared with the bytes
at that locator. Digests whose texts differ are grouped by their full bytes instead. State and content outlive
the run: another call on the same folder goes on from them with the files that are new.

A group of copies reaches the state as a row for each task that has read some, however large it is.
Content files of a task that was run twice are of different names; locators name the ones that count.

Defined cases: a null text is empty; ids that are null are the smallest; where rows repeat an id with its
text and that id stays, one of them does; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import open_store, shared_folder
from .text import in_batches, utf8

#: Bytes of texts that a task holds to collapse equal ones before it hands them on.
HELD_BYTES = 64 << 20
#: Files that a micro-batch takes at most.
FILES = 1000
#: Settings of the session while a stream runs or its state is read: on disk without files allocated ahead, only changes
#: written, and little memory a partition, which is given back when a batch is committed. Files are renamed through the
#: FileSystem interface: on local folders the other one starts a process for each look at a file, a twin of the executor until it has begun.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}
#: Content files that a task keeps open for reading.
OPEN_FILES = 64


class ContentWriter:
    """Appends compressed texts to a file that it creates with the first one."""

    def __init__(self, root: str) -> None:
        import zstandard

        self.store, self.folder = open_store(root)
        self.name, self.at, self.out, self.codec = f"content-{uuid.uuid4().hex}.bin", 0, None, zstandard.ZstdCompressor(1)

    def append(self, data: bytes) -> tuple[str, int, int]:
        """The locator of ``data``: file, offset and length."""
        if self.out is None:
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        packed, start = self.codec.compress(data), self.at
        self.out.write(packed)
        self.at += len(packed)
        return self.name, start, len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class ContentReader:
    """Reads texts by locator."""

    def __init__(self, root: str) -> None:
        import zstandard

        self.store, self.folder = open_store(root)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.codec = zstandard.ZstdDecompressor()

    def __call__(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            self.files[file] = self.store.open_input_file(f"{self.folder}/{file}")
            if len(self.files) > OPEN_FILES:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(file)
        return self.codec.decompress(self.files[file].read_at(length, offset))


def distinct_texts(docs: DataFrame, root: str, digest_bytes: int = 32) -> DataFrame:
    """``digest, n, top_id, file, offset, length`` of the texts of ``docs``, those within a task's reach collapsed."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ContentWriter(root)
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(hashlib.sha256(text).digest()[:digest_bytes], n, top, *writer.append(text)) for text, (n, top) in held.items()]
            types = (pa.binary(), pa.int64(), kind, pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "n", "top_id", "file", "offset", "length"])

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = utf8(text)
                if entry := held.get(data):
                    entry[0] += 1
                    entry[1] = _greater(entry[1], doc_id)
                    continue
                held[data] = [1, doc_id]
                size += len(data) + 200
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()
        writer.close()

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, f"digest binary, n bigint, top_id {id_type}, file string, offset bigint, length bigint")


def _greater(a, b):
    return a if b is None or a is not None and a >= b else b


def absorb(docs: DataFrame, root: str, digest_bytes: int = 32) -> None:
    """Runs the stream ``docs`` over all files there are, into the state below ``root``, and compares bytes on hits."""
    spark = docs.sparkSession
    done = _runs(root)
    texts = distinct_texts(docs, f"{root}/content", digest_bytes).withColumn("run", F.lit(done + 1))
    place = F.struct("run", "file", "offset", "length")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        _to_end(texts.writeStream.format("parquet").option("path", f"{root}/texts").option("checkpointLocation", f"{root}/checkpoint-texts"))
        seen = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/texts")
        state = seen.groupBy("digest").agg(F.sum("n").alias("n"), F.max("top_id").alias("top_id"), F.min(place).alias("place"))
        _to_end(state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/checkpoint-state"))
        held = spark.read.format("statestore").load(f"{root}/checkpoint-state")
        value = [F.col("value")[f.name].alias(n) for f, n in zip(held.schema["value"].dataType, ("n", "top_id", "place"))]
        held.select("key.digest", *value).write.parquet(f"{root}/groups/{done + 1}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    _differing(spark, root, done).write.parquet(f"{root}/differing/{done + 1}")


def _to_end(stream) -> None:
    stream.trigger(availableNow=True).start().awaitTermination()


def _runs(root: str) -> int:
    """Runs whose hits have been compared."""
    from pyarrow import fs

    store, path = open_store(root)
    return max((int(f.base_name) for f in store.get_file_info(fs.FileSelector(f"{path}/differing", allow_not_found=True))), default=0)


def groups(spark: SparkSession, root: str) -> DataFrame:
    """``digest, n, top_id, place`` of all digests in the state."""
    return spark.read.parquet(f"{root}/groups/{_runs(root)}")


def _differing(spark: SparkSession, root: str, done: int) -> DataFrame:
    """Digests of texts, seen by runs after ``done``, whose bytes are not those at the state's locator."""
    state = spark.read.parquet(f"{root}/groups/{done + 1}").select("digest", "place")
    texts = spark.read.parquet(f"{root}/texts").where(F.col("run") > done).withColumn("own", F.struct("run", "file", "offset", "length"))
    places = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("own", "place") for c in ("file", "offset", "length")]
    hits = texts.join(state, "digest").where("own <> place").select("digest", *places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ContentReader(f"{root}/content")
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            yield batch.filter(pa.array([read(*r[:3]) != read(*r[3:]) for r in rows], pa.bool_())).select([0])

    return hits.mapInArrow(run, "digest binary").distinct()


def dedup_report(docs: DataFrame, root: str, digest_bytes: int = 32) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row of ``docs``, all of whose texts the state has seen."""
    spark = docs.sparkSession
    found = groups(spark, root)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    text = text.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    differing = spark.read.schema("digest binary").parquet(f"{root}/differing/*").distinct()
    several = not differing.isEmpty()
    clean = found.join(differing, "digest", "left_anti") if several else found
    out = text.groupBy("doc_id", "text_sha256", "digest").count().join(clean.select("digest", "n", "top_id"), "digest")
    if several:
        out = out.unionByName(_by_bytes(text, differing, root))
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    stays = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("copy") == 1)
    return each.select("doc_id", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "text_sha256")


def _by_bytes(text: DataFrame, differing: DataFrame, root: str) -> DataFrame:
    """Rows of ``text`` whose digest stands for several texts, grouped by all bytes of what the content files hold."""
    seen = text.sparkSession.read.parquet(f"{root}/texts").join(differing, "digest").select("digest", "n", "top_id", "file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ContentReader(f"{root}/content")
        for batch in batches:
            bodies = [read(*place) for place in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.binary())], ["digest", "n", "top_id", "body"])

    kind = seen.schema["top_id"].dataType.simpleString()
    bodies = in_batches(seen).mapInArrow(run, f"digest binary, n bigint, top_id {kind}, body binary")
    sizes = bodies.groupBy("digest", "body").agg(F.sum("n").alias("n"), F.max("top_id").alias("top_id"))
    own = text.groupBy("doc_id", "text_sha256", "digest", "body").count()
    return own.join(sizes, ["digest", "body"]).drop("body")


def exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    """The report of the table at ``path``, its files read as a stream into a new state."""
    docs, root = spark.read.parquet(path), shared_folder(spark, "exact-dedup")
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, since a stream takes a plain path for a folder, and this may be one file
    absorb(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", FILES).parquet(either), root)
    return dedup_report(docs, root)
