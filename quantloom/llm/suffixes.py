"""Exact removal of repeated long strings by anchored runs of positions with hashed cores.

A position is repeated if the ``LENGTH`` bytes that start there also start at another position. This
takes the place of prefix doubling: no ranks are kept, no positions sorted and no offsets doubled.
Strings of three fixed lengths, one a round, are named by their hash and counted, so that a hundredth
of the positions travels instead of all of them with a sort in each round:

* neighbouring positions are handled as runs. Each ``LENGTH``-byte string has an anchor, the place of
  the least 8-byte hash among those followed by ``CORE`` of its bytes. Starts with one anchor form a
  run, and equal strings have equal anchors, so only runs of equal anchors are compared;
* in round ``r`` a run is cut into cells of ``CELLS[r]`` starts, at fixed distances from the anchor. A
  cell's core, the bytes that all its strings share, is what is hashed and counted; it has 351, 394 and
  ``LENGTH`` bytes as cells shrink to one start. Cells with a unique core drop out;
* a cell whose whole extent (all bytes of all its strings) is repeated is settled at once.

Bloom filters tell which runs to take from the texts, and which texts have any of those taken late, so no text is shuffled in the
rounds; what they let pass in error is told apart by joins. Extents are compared by 128-bit
fingerprints. A settled extent stays in the rounds as one row that counts twice, as long as an open
cell has its core. Groups are counted before the shuffle, never gathered, and that one row comes from the
counting too. The counts are written before the joins with them, and no step on the same key follows, so
that adaptive execution may split a join where a string has very many copies.

A passage that is shared but shorter than ``LENGTH`` loses nothing. Documents that hold one can be told
by ``n_copied``, the passages of 51 words that stand in another document too (``passages``), and more loosely
by ``n_shared``: of the anchors whose core repeats, those whose surroundings (``AROUND`` bytes before and
behind) stand in another document too.

Defined cases: null is an empty text; texts below ``LENGTH`` bytes lose nothing; a repeated row is
another document, so both copies go; a text of one repeated byte loses everything from ``LENGTH`` + 1
bytes on; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bloom import bloom, holding, passes
from .decontaminate import merged
from .passages import shared_passages
from .storage import written
from .text import anchored_runs, in_batches, pieces, utf8

#: Bytes of a string, bytes at its anchor that all strings of a run share, and starts in a cell by round.
LENGTH, CORE, CELLS = 400, 64, (50, 7, 1)
#: Bytes before and behind an anchor that are compared between documents.
AROUND = (32, 96)
#: Bytes of text that a task works on at once; its arrays take some hundred bytes for each.
PIECE = 1 << 20
_KEY = ("k1", "k2")
_EXTENT = ("e1", "e2")


def runs_of(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The joined texts, and a row (text, first start, last start, anchor) for each run; offsets within the joined texts."""
    window = LENGTH - CORE + 1
    ends = np.cumsum([0, *map(len, texts)])
    n = int(ends[-1])
    data = b"".join([*texts, bytes(window + 8)])
    key = np.full(-(-(n + window) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    own = key[: n + window]
    np.multiply(np.ndarray((n + window,), "<u8", data, strides=(1,)), np.uint64(0x9E3779B97F4A7C15), out=own)
    own &= np.uint64(0xFFFFFFFF00000000)
    own |= np.arange(n + window, dtype=np.uint64)
    return data, anchored_runs(key, ends, window, LENGTH)


def _names(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """64-bit names of the spans' bytes."""
    from xxhash import xxh3_64_intdigest

    view = memoryview(data)
    return np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(spans))


def _long_names(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """128-bit names of the spans' bytes, as an (n, 2) array."""
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    return np.frombuffer(b"".join(xxh3_128_digest(view[a:b]) for a, b in spans), "<i8").reshape(-1, 2)


def _tagged(core: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Names of cores (even) and extents (odd) in one space."""
    one = np.uint64(1)
    return np.concatenate((core & ~one, extent | one))


def _run_names(data: bytes, runs: np.ndarray) -> np.ndarray:
    rows = runs.tolist()
    return _tagged(_names(data, [(a, a + CORE) for *_, a in rows]), _names(data, [(s, e + LENGTH) for _, s, e, _ in rows]))


def repeated_filter(docs: DataFrame) -> np.ndarray:
    """A filter of the names that two runs or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([pa.array(_run_names(*runs_of(texts)).view(np.int64))], ["name"])

    names = docs.select("text").mapInArrow(run, "name long").groupBy("name").agg(F.count("*").alias("n"))
    return bloom(names.where("n > 1"))


_NAMES = [*_KEY, "start", "last", "anchor", "core", "e1", "e2", "bytes", "around"]
_RUNS = "k1 long, k2 int, start long, last long, anchor long, core long, e1 long, e2 long, bytes binary, around long"


def _run_rows(part: pa.RecordBatch, texts: list[bytes], data: bytes, own: np.ndarray, core: np.ndarray, keep: bool) -> pa.RecordBatch:
    """Rows of the chosen runs, with their bytes if ``keep``, and the names of what surrounds their anchors."""
    doc, first, last, anchor = own.T
    ends = np.cumsum([0, *map(len, texts)])
    base = ends[doc]
    inside = (anchor - AROUND[0] >= base) & (anchor + AROUND[1] <= ends[doc + 1])
    around = _names(data, [(p - AROUND[0], p + AROUND[1]) for p in anchor.tolist()] if len(own) else [])
    spans = [(s, e + LENGTH) for s, e in zip(first.tolist(), last.tolist())]
    extent = np.ascontiguousarray(_long_names(data, spans).T)
    kept = pa.array([data[a:b] for a, b in spans], pa.binary()) if keep else pa.nulls(len(own), pa.binary())
    keys = [part.column(k).take(pa.array(doc)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(x - base) for x in (first, last, anchor)), pa.array(core.view(np.int64)), *map(pa.array, extent), kept, pa.array(around.view(np.int64), mask=~inside)], _NAMES)


def candidate_runs(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Runs whose core the filter holds; with their bytes unless the filter holds the whole extent too."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", PIECE):
            data, runs = runs_of(texts)
            names = _run_names(data, runs)
            core, extent = passes(shared.value, names).reshape(2, -1)
            for settled in (True, False):
                chosen = core & (extent == settled)
                if chosen.any():
                    yield _run_rows(part, texts, data, runs[chosen], names[: len(runs)][chosen], not settled)

    return docs.select(*_KEY, "text").mapInArrow(run, _RUNS)


def chosen_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs named by ``k1, k2, start`` of ``wanted``, with their bytes and its other columns, in one more pass over the texts that have any."""
    place = F.col("k1").bitwiseXOR(F.shiftleft("start", 36)).bitwiseXOR(F.shiftleft("start", 8))
    names = wanted.select(place.alias("name")).union(wanted.select("k1").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bloom(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(holding(batches, shared.value), "text", PIECE):
            data, runs = runs_of(texts)
            start = (runs[:, 1] - np.cumsum([0, *map(len, texts)])[runs[:, 0]]).astype(np.uint64)
            key = part.column(0).to_numpy()[runs[:, 0]].view(np.uint64)
            own = runs[passes(shared.value, key ^ start << np.uint64(36) ^ start << np.uint64(8))]
            if len(own):
                core = _names(data, [(a, a + CORE) for *_, a in own.tolist()])
                yield _run_rows(part, texts, data, own, core, True)

    found = docs.select(*_KEY, "text").mapInArrow(run, _RUNS).dropDuplicates([*_KEY, "start"])
    return found.join(wanted, [*_KEY, "start"])


def cells(runs: DataFrame, size: int) -> DataFrame:
    """Cells of ``size`` starts of the ``open`` ranges (flat: first, last, ...) of runs with their bytes."""
    names = ["k1", "k2", "start", "first", "last", "core", "e1", "e2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            start, anchor, data, ranges = (batch.column(k).to_pylist() for k in (3, 4, 5, 6))
            owner, firsts, lasts, cores, extents = [], [], [], [], []
            for i, (base, a, own, flat) in enumerate(zip(start, anchor, data, ranges)):
                for first, last in zip(flat[::2], flat[1::2]):
                    for cell in range((a - last) // size, (a - first) // size + 1):
                        near, far = cell * size, cell * size + size - 1
                        low, high = max(first, a - far), min(last, a - near)
                        owner.append(i)
                        firsts.append(low)
                        lasts.append(high)
                        cores.append(xxh3_64_intdigest(own[a - near - base : a - far - base + LENGTH]))
                        extents.append(xxh3_128_digest(own[low - base : high - base + LENGTH]))
            core = np.array(cores, np.uint64).view(np.int64)
            extent = np.ascontiguousarray(np.frombuffer(b"".join(extents), "<i8").reshape(-1, 2).T)
            k1, k2, n, base = (batch.column(k).take(pa.array(owner, pa.int64())) for k in range(4))
            yield pa.RecordBatch.from_arrays([k1, k2, base, pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(core), *map(pa.array, extent), n], names)

    rows = runs.select(*_KEY, "n", "start", "anchor", "bytes", "open")
    return rows.mapInArrow(run, "k1 long, k2 int, start long, first long, last long, core long, e1 long, e2 long, n int")


def _repeated(rows: DataFrame, names: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """Names that stand for two positions or more, with further columns of one row each; a row stands for ``n`` positions."""
    counted = rows.groupBy(*names).agg(F.sum("n").alias("__n"), *(F.first(c).alias(c) for c in also))
    return written(counted.where("__n > 1").drop("__n"), "suffix-repeated")


def _spans(rows: DataFrame, first: str) -> DataFrame:
    return rows.select(*_KEY, F.col(first).alias("a"), (F.col("last") + LENGTH).alias("b"))


def _told(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """The rows with ``whole``, true where their extent is repeated and else null; such rows keep no core."""
    known = rows.join(twice.select(*_EXTENT, F.lit(True).alias("whole")), list(_EXTENT), "left").drop(*_EXTENT)
    return written(known.withColumn("core", F.when(F.col("whole").isNull(), F.col("core"))), "suffix-told")


def _partners(twice: DataFrame, opened: DataFrame) -> DataFrame:
    """The row of each repeated extent whose core ``opened`` has too: what is open is compared with it further."""
    return twice.join(opened.select("core").distinct(), "core", "left_semi").withColumn("n", F.lit(2))


def repeated_spans(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``k1, k2, a, b``: byte ranges of repeated strings, from documents with their keys and their runs; ranges may overlap."""
    twice = _repeated(runs, _EXTENT, (*_KEY, "start", "core"))
    named = _told(runs.where("bytes IS NULL").drop("anchor", "bytes", "around"), twice)
    missed = named.where("whole IS NULL")
    opened = runs.where("bytes IS NOT NULL").select(*_KEY, "start", "last", "anchor", "core", "n", "bytes")
    found = [_spans(named.where("whole"), "start")]
    alike = opened.select("core").union(missed.select("core"))
    wanted = written(_partners(twice, alike).select(*_KEY, "start", "n").union(missed.select(*_KEY, "start", "n")), "suffix-wanted")
    more = written(chosen_runs(docs, wanted).select(*opened.columns), "suffix-more")
    opened = opened.union(more).withColumn("open", F.array("start", "last"))
    for size in CELLS:
        now = written(cells(opened, size), "suffix-cells")
        twice = _repeated(now, _EXTENT, (*_KEY, "start", "first", "last", "core"))
        told = _told(now, twice)
        found.append(_spans(told.where("whole"), "first"))
        if size > 1:
            left = told.where("whole IS NULL").drop("whole").join(_repeated(now, ("core",)), "core", "left_semi")
            left = left.unionByName(_partners(twice, left).drop(*_EXTENT))
            left = left.groupBy(*_KEY, "start", "n").agg(F.flatten(F.collect_set(F.array("first", "last"))).alias("open"))
            known = opened.select(*_KEY, "start", "anchor", "bytes").dropDuplicates([*_KEY, "start"])
            opened = written(known.join(left, [*_KEY, "start"]), "suffix-open")
    return reduce(DataFrame.unionByName, found)


def shared_anchors(runs: DataFrame) -> DataFrame:
    """``k1, k2`` of each anchor whose surroundings stand in another document too."""
    ends = [f(c).alias(f"{n}{c}") for c in _KEY for n, f in (("least", F.min), ("most", F.max))]
    rows = runs.where("around IS NOT NULL").select(*_KEY, "around")
    several = rows.groupBy("around").agg(*ends).where("leastk1 <> mostk1 OR leastk2 <> mostk2").select("around")
    return rows.join(written(several, "suffix-shared"), "around", "left_semi").select(*_KEY)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_shared, n_copied`` of each document; ``spans`` are the removed byte ranges."""
    keyed = in_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    plain = keyed.select(*_KEY, "text")
    runs = written(candidate_runs(plain, repeated_filter(plain)).withColumn("n", F.lit(1)), "suffix-runs")
    spans = repeated_spans(plain, runs).select(*_KEY, F.array("a", "b").alias("span"))
    both = spans.unionByName(shared_anchors(runs).withColumn("shared", F.lit(1)), allowMissingColumns=True).unionByName(shared_passages(plain), allowMissingColumns=True)
    spans = both.groupBy(*_KEY).agg(F.flatten(F.collect_set("span")).alias("spans"), F.count("shared").alias("n_shared"), F.max("n_copied").alias("n_copied"))
    kind, numbers = docs.schema["doc_id"].dataType.simpleString(), ("n_shared", "n_copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, removed = utf8(text), merged(zip(flat[::2], flat[1::2])) if flat else []
                sha, end = hashlib.sha256(), 0
                for a, b in removed:
                    sha.update(data[end:a])
                    end = b
                sha.update(data[end:])
                rows.append((len(data), sum(b - a for a, b in removed), len(removed), sha.hexdigest(), [x for span in removed for x in span]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), batch.column(3), batch.column(4)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *numbers])

    joined = keyed.join(spans, list(_KEY), "left").select("doc_id", "text", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers))
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, n_shared long, n_copied long")
