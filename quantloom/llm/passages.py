"""Exact count of passages of ``WORDS`` words that stand in another document too.

A passage is ``WORDS`` consecutive words, whatever white space parts them; one starts at every word. None
is compared before it has something in common with another document:

* a passage's anchor is the word with the least hash of 16 bytes among those followed by ``CORE`` of its words. Passages
  with one anchor form a run of about 14; equal passages have equal anchors, so only runs with equal cores
  (the ``CORE`` words at the anchor) are compared. Cores are counted first, once a text, and a Bloom filter tells those of two texts;
* a run whose whole extent (all words of its passages) stands in another document is settled as one row;
* of all other runs whose core stands in another text the passages are named and counted, together with those of one run
  of each settled extent that has such a core; that run's passages count for two documents.

Extents and passages are compared by 128-bit fingerprints. Counts are written before the joins with them, so that adaptive
execution may split a join where a passage has very many copies.

Defined cases: null is an empty text; texts below ``WORDS`` words have none; passages repeated within one
document only don't count; a repeated row is another document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bloom import bloom, holding, passes
from .storage import written
from .text import anchored_runs, pieces

#: Words of a passage, and words at its anchor that all passages of a run share: at least 16 bytes.
WORDS, CORE = 51, 24
#: Bytes of text that a task works on at once.
PIECE = 1 << 20
_KEY = ("k1", "k2")
_EXTENT = ("e1", "e2")


def word_runs(texts: list[bytes]) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """The words parted by single blanks, the offset of each, the first word of each text, and a row (text, first, last, anchor) for each run."""
    counts, lines = [0], []
    for text in texts:
        words = text.split()
        counts.append(len(words))
        if words:
            lines.append(b" ".join(words))
    ends = np.cumsum(counts)
    n, window = int(ends[-1]), WORDS - CORE + 1
    data = b" ".join(lines) + b" " * bool(n)
    offset = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1))
    gram = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))
    own = gram[offset[:n]] * np.uint64(0x9E3779B97F4A7C15) + gram[offset[:n] + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = np.full(-(-(n + window) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    return memoryview(data), offset, ends, anchored_runs(key, ends, window, WORDS)


def _cores(data: memoryview, offset: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """64-bit names of the runs' cores."""
    from xxhash import xxh3_64_intdigest

    a, b = offset[runs[:, 3]].tolist(), (offset[runs[:, 3] + CORE] - 1).tolist()
    return np.fromiter((xxh3_64_intdigest(data[x:y]) for x, y in zip(a, b)), np.uint64, len(a))


def _names(data: memoryview, offset: np.ndarray, first: np.ndarray, behind: np.ndarray) -> list[pa.Array]:
    """128-bit names of ranges of words, as two columns."""
    from xxhash import xxh3_128_digest

    a, b = offset[first].tolist(), (offset[behind] - 1).tolist()
    digests = np.frombuffer(b"".join(xxh3_128_digest(data[x:y]) for x, y in zip(a, b)), "<i8").reshape(-1, 2)
    return [pa.array(x) for x in np.ascontiguousarray(digests.T)]


def repeated_cores(docs: DataFrame) -> np.ndarray:
    """A filter of the cores that two texts or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", PIECE):
            data, offset, _, runs = word_runs(texts)
            core = _cores(data, offset, runs)
            order = np.lexsort((core, runs[:, 0]))
            core, text = core[order], runs[order, 0]
            new = np.ones(len(core), bool)
            new[1:] = (core[1:] != core[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(core[new].view(np.int64))], ["name"])

    names = docs.select("text").mapInArrow(run, "name long").groupBy("name").agg(F.count("*").alias("n"))
    return bloom(names.where("n > 1"))


def candidate_runs(docs: DataFrame, cores: np.ndarray) -> DataFrame:
    """``k1, k2, first, n, core, e1, e2`` of each run whose core the filter holds; ``n``: its passages."""
    shared = docs.sparkSession.sparkContext.broadcast(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", PIECE):
            data, offset, ends, runs = word_runs(texts)
            core = _cores(data, offset, runs)
            chosen = passes(shared.value, core)
            text, first, last, _ = runs[chosen].T
            columns = [*(part.column(k).take(pa.array(text)) for k in (0, 1)), pa.array(first - ends[text]), pa.array((last - first + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(core[chosen].view(np.int64)), *_names(data, offset, first, last + WORDS)], [*_KEY, "first", "n", "core", *_EXTENT])

    return docs.select(*_KEY, "text").mapInArrow(run, "k1 long, k2 int, first long, n int, core long, e1 long, e2 long")


def passages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k1, k2, twice, w1, w2``: names of the passages of the runs in ``wanted`` (``k1, k2, first, twice``)."""
    place = F.col("k1").bitwiseXOR(F.shiftleft("first", 36)).bitwiseXOR(F.shiftleft("first", 8))
    names = wanted.select(place.alias("name")).union(wanted.select("k1").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bloom(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(holding(batches, shared.value), "text", PIECE):
            data, offset, ends, runs = word_runs(texts)
            first = (runs[:, 1] - ends[runs[:, 0]]).astype(np.uint64)
            key = part.column(0).to_numpy()[runs[:, 0]].view(np.uint64)
            chosen = passes(shared.value, key ^ first << np.uint64(36) ^ first << np.uint64(8))
            if not chosen.any():
                continue
            text, low, high, _ = runs[chosen].T
            until = np.cumsum(high - low + 1)
            start = np.arange(until[-1]) + np.repeat(low - np.concatenate(([0], until[:-1])), high - low + 1)
            names = pa.StructArray.from_arrays(_names(data, offset, start, start + WORDS), ["w1", "w2"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], until)), pa.int32()), names)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(text)) for k in (0, 1)), pa.array(low - ends[text]), lists], [*_KEY, "first", "names"])

    found = docs.select(*_KEY, "text").mapInArrow(run, "k1 long, k2 int, first long, names array<struct<w1: long, w2: long>>")
    return found.join(wanted, [*_KEY, "first"]).select(*_KEY, "twice", F.inline("names"))


def _several(rows: DataFrame, *names: str) -> DataFrame:
    """Names that stand in two documents or more, with the least row ``k1, k2, first`` of each as ``one``."""
    ends = [f(c).alias(f"{n}_{c}") for c in _KEY for n, f in (("least", F.min), ("most", F.max))]
    counted = rows.groupBy(*names).agg(*ends, F.min(F.struct(*_KEY, "first")).alias("one"))
    return counted.where("least_k1 <> most_k1 OR least_k2 <> most_k2").select(*names, "one")


def shared_passages(docs: DataFrame) -> DataFrame:
    """``k1, k2, n_copied``: of documents with their keys and texts, how many passages stand in another one; those without may be missing."""
    runs = written(candidate_runs(docs, repeated_cores(docs)), "passage-runs")
    settled = written(_several(runs, "core", *_EXTENT), "passage-settled")
    extents = settled.select(*_EXTENT, F.lit(True).alias("whole"))
    told = written(runs.join(extents, list(_EXTENT), "left").select(*_KEY, "first", "n", "core", "whole"), "passage-told")
    opened = told.where("whole IS NULL").select(*_KEY, "first", "core")
    partners = settled.join(opened.select("core").distinct(), "core", "left_semi").select("one.*", F.lit(True).alias("twice"))
    wanted = written(opened.select(*_KEY, "first", F.lit(False).alias("twice")).dropDuplicates().union(partners), "passage-wanted")
    named = written(passages(docs, wanted), "passage-names")
    ends = [f(c).alias(f"{n}_{c}") for c in _KEY for n, f in (("least", F.min), ("most", F.max))]
    counted = named.groupBy("w1", "w2").agg(*ends, F.max("twice").alias("twice"))
    several = written(counted.where("twice OR least_k1 <> most_k1 OR least_k2 <> most_k2").select("w1", "w2"), "passage-several")
    found = named.where("NOT twice").join(several, ["w1", "w2"], "left_semi").select(*_KEY, F.lit(1).alias("copied"))
    rows = told.select(*_KEY, "first", "n", F.when(F.col("whole"), F.col("n")).alias("copied")).unionByName(found, allowMissingColumns=True)
    # every run of a repeated row is a candidate, as often as there are copies
    counts = rows.groupBy(*_KEY).agg(F.count_if(F.col("first") == 0).alias("rows"), F.sum("n").alias("n"), F.sum("copied").alias("copied"))
    return counts.select(*_KEY, F.expr("CASE WHEN rows > 1 THEN n DIV rows ELSE coalesce(copied, 0) END").alias("n_copied"))
