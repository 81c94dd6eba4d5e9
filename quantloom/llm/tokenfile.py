"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a sequence of blocks, each readable by one range read:

    magic "QLT1", then five little-endian 64-bit lengths: documents table, ranks, control, data, ids
    documents table: Arrow stream of doc_id and n_tokens
    ranks: 32-bit token ids, most frequent in the block first (ties: smaller id)
    control: two bits for each id, four ids a byte, the number of data bytes less one
    data: the low bytes of each id's rank

Documents stand in ascending order of doc_id (nulls first): Spark deals them out by range, and every
task writes the blocks of its range to a file of its own. A retried task writes another file; index
rows name the files that count.

Defined cases: a null or empty text is the end id alone; documents of one doc_id stand in order of
their texts; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import open_store, shared_folder, written
from .text import in_batches, utf8

MAGIC, HEAD = b"QLT1", struct.Struct("<4s5q")
#: Ids in a block, after which a new one begins.
BLOCK_IDS = 1 << 21
#: Words whose encodings a worker keeps, in each of two generations, and words that are encoded as one text.
CACHE_WORDS, JOINED_WORDS = 700_000, 500
#: Bytes of data for each of the four ids of a control byte.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
_PLACE = np.arange(4, dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[_PLACE < size[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``, their sizes by table lookup."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_PLACE < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def encode_block(doc_ids: pa.Array, lengths: list[int], ids: np.ndarray) -> bytes:
    """One block, of documents whose ids follow one another in ``ids``."""
    counts = np.bincount(ids)
    ranks = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    table = pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    parts = [sink.getvalue().to_pybytes(), ranks.astype("<u4").tobytes(), *pack(rank_of[ids])]
    return HEAD.pack(MAGIC, *map(len, parts), len(ids)) + b"".join(parts)


def decode_block(block: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    """The documents table and the ids of a block."""
    magic, *sizes, n = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    ends = np.cumsum([HEAD.size, *sizes])
    table, ranks, control, data = (block[a:b] for a, b in zip(ends, ends[1:]))
    with pa.ipc.open_stream(table) as stream:
        documents = stream.read_next_batch()
    return documents, np.frombuffer(ranks, "<u4")[unpack(control, data, n)]


class WordEncoder:
    """Ids of texts from a lower-casing tokenizer that parts text at ASCII white space, and letters from other marks.

    Each word is encoded once while it is cached, a comma or full stop behind it apart. A text with
    the beginning of a special token's string is encoded as a whole. ``word_bpe_49k.json`` is such a
    tokenizer; the tests compare with its encoding of whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece of text
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {m[0]: self._whole([m])[0] for m in (b",", b".")}

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text, then ``end``."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        words, cuts, whole = [], [0], {}
        for k, text in enumerate(texts):
            data = utf8(text)
            if b"<|" in data:
                whole[k] = self._whole([data])[0]
            else:
                words += data.lower().split()
            cuts.append(len(words))
        ids = list(map(self.new.get, words))
        if None in ids:
            holes = [k for k, x in enumerate(ids) if x is None]
            wanted = {words[k] for k in holes}
            kept = self.old.keys() & wanted
            self.new.update((w, self.old[w]) for w in kept)
            self._learn(wanted.difference(kept))
            for k in holes:
                ids[k] = self.new[words[k]]
        return [(whole.get(k) or b"".join(ids[a:b])) + end for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn(self, words: set[bytes]) -> None:
        marked = [w for w in words if len(w) > 1 and w[-1] in b",." and 97 <= w[-2] <= 122]
        stems = {w[:-1] for w in marked}.difference(self.new)
        self.new.update((w, self.old[w]) for w in self.old.keys() & stems)
        self._learn_plain((words.difference(marked) | stems).difference(self.new))
        self.new.update((w, self.new[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def _learn_plain(self, words: set[bytes]) -> None:
        plain = [w for w in words if w.isalpha() or not w.isascii() and w.decode("utf-8", "surrogatepass").isalpha()]
        for k in range(0, len(plain), JOINED_WORDS):
            self._joined(plain[k : k + JOINED_WORDS])
        rest = list(words.difference(self.new))
        self.new.update(zip(rest, self._whole(rest)))

    def _joined(self, words: list[bytes]) -> None:
        """Encodes words as one text and parts its ids behind those that end a piece, if every word is one piece."""
        raw = self._whole([b" ".join(words)])[0]
        cuts = (4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)).tolist()
        if len(cuts) == len(words) and cuts[-1] == len(raw):
            self.new.update((w, raw[a:b]) for w, a, b in zip(words, [0, *cuts], cuts))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, root: str) -> DataFrame:
    """Writes token files below ``root``; index rows ``part, block, file, offset, length, n_ids`` in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = word_encoder(tokenizer), struct.pack("<I", end_id)
        store, path = open_store(root)
        store.create_dir(path, recursive=True)
        name, part = f"tokens-{uuid.uuid4().hex}.bin", TaskContext.get().partitionId()
        out, at, index = None, 0, []
        held: list[bytes] = []
        owners: list[pa.Array] = []

        def flush() -> None:
            nonlocal out, at
            if held:
                out = out or store.open_output_stream(f"{path}/{name}")
                block = encode_block(pa.concat_arrays(owners), [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"))
                out.write(block)
                index.append((part, len(index), name, at, len(block), sum(map(len, held)) // 4))
                at += len(block)
                held.clear()
                owners.clear()

        for batch in batches:
            texts = batch.column(1)
            for k in range(0, batch.num_rows, 256):
                held += encoder.encode(texts.slice(k, 256).to_pylist(), end)
                owners.append(batch.column(0).slice(k, 256))
                if sum(map(len, held)) >= 4 * BLOCK_IDS:
                    flush()
        flush()
        if out:
            out.close()
            columns = zip(*index)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "block", "file", "offset", "length", "n_ids"])

    ordered = in_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part long, block long, file string, offset long, length long, n_ids long")


def block_starts(index: DataFrame) -> DataFrame:
    """Index rows with ``start``, the ids in all blocks before; sums by part first, so one task sees a row a part."""
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    return index.join(parts, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))


def read_tokens(index: DataFrame, root: str, doc_id: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the blocks of ``index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(root)
        for batch in batches:
            for name, offset, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{path}/{name}") as file:
                    documents, ids = decode_block(file.read_at(length, offset))
                sizes = documents.column(1).to_numpy()
                ends = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([documents.column(0), pa.array(start + ends - sizes), documents.column(1), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of partitions, since index rows are too small for adaptive execution to spread their work
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length", "start").repartition(spread, "file", "offset")
    return rows.mapInArrow(run, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")


def token_file_columns(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all documents' ids and returns what the files hold of each."""
    root = shared_folder(docs.sparkSession, "tokens")
    index = written(write_tokens(docs, tokenizer, end_id, f"{root}-bin"), "tokens-index")
    return read_tokens(block_starts(index), f"{root}-bin", docs.schema["doc_id"].dataType.simpleString())
