"""Byte-level text helpers used by several operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Rows of an Arrow batch of texts; texts are long, so Spark's default for batches would fill a worker's memory.
BATCH_ROWS = 1024


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after bounding the Arrow batches that its session sends to workers."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of ``text``; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def spaced_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the maximal runs of bytes other than 09-0D and 20."""
    return utf8(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the maximal runs of digits, a-z and non-ASCII bytes."""
    return utf8(text).translate(ALNUM_TABLE).split()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows dealt anew to batches of at most ``limit`` bytes of ``column`` (one row at least), with those bytes."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
            data = utf8(text)
            if texts and size + len(data) > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(), texts
                held, texts, size, start = [], [], 0, i
            texts.append(data)
            size += len(data)
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if texts:
        yield joined(), texts


def anchored_runs(key: np.ndarray, ends: np.ndarray, window: int, length: int) -> np.ndarray:
    """A row (text, first, last, anchor) for each run of neighbouring starts with one anchor, the place of the least of ``window`` keys.

    ``key`` has the places in its low 32 bits, largest keys behind the last text, and whole rows of ``window``; it is overwritten. Text ``i`` is from ``ends[i]``
    to ``ends[i + 1]``; what starts in it has ``length`` places.
    """
    rows, n, texts = key.reshape(-1, window), int(ends[-1]), len(ends) - 1
    ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    np.minimum.accumulate(rows, 1, out=rows)
    least = np.minimum(ahead[:n], key[window - 1 : n + window - 1])
    first = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, ends[:-1])
    text = np.searchsorted(ends, first, "right") - 1
    first, text = first[text < texts], text[text < texts]
    last = np.minimum(np.append(first[1:], n) - 1, ends[text + 1] - length)
    kept = last >= first
    first = first[kept]
    return np.stack((text[kept], first, last[kept], (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)), 1)
