"""Filter interaction audit: what each of five filters removes in every order of applying them.

A document's failures make a mask of five bits. A table of 32 masks by 120 orders holds the step at which
an order first removes such a document, so no order is ever run: each task counts its masks by part and
label, looks their steps up, and sums removals with ``np.bincount``; Spark then sums the tasks' arrays.

Texts are read once and not shuffled; what moves is an id, a digest and a mask a document. Equal texts
have equal SHA-256 digests. A task holds counts of at most ``PARTS`` parts at a time.

Defined cases: a null text is empty; a null source is the empty string's part; a document without id is
never counted as a later copy, nor is another one for its sake; rows repeated with their id stand for
documents of their own, all of them the first of their text if one is; a label counts if any of the
labels rows of an id has it, null labels and labels of no id don't; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import written
from .text import in_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Limits of the filters: words, percent of distinct words, percent of capitals, and characters that texts shouldn't hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Parts whose counts a task holds before it hands them on.
PARTS = 512
#: The step of each filter in each order, and the step (``STEPS``: none) at which an order removes a mask.
PLACE = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
FIRST = np.array([np.where([mask >> k & 1 for k in range(STEPS)], PLACE, STEPS).min(axis=1) for mask in range(1 << STEPS)])
#: Sizes of a part's array: documents by mask, then removals by order and step of all, good and toxic documents.
MASKS, CELLS = 1 << STEPS, len(ORDERS) * STEPS
REPORT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(data: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()
    distinct = len(set(words))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (len(words) < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * n_chars) << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3


def text_failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document, the mask without filter E."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            raw, sizes = texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist()
            masks = pa.array([text_mask(t, n) for t, n in zip(raw, sizes)], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, masks], ["doc_id", "part", "digest", "mask"])

    own = in_batches(docs).select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")


def with_copies(failures: DataFrame) -> DataFrame:
    """Adds filter E to the masks of documents whose text stands under a smaller id.

    The row that stands first is joined by digest and id together, so no group of copies meets in a task.
    """
    firsts = failures.groupBy(F.col("digest").alias("d"), F.lit(True).alias("first")).agg(F.min("doc_id").alias("i")).where("i IS NOT NULL")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = failures.join(firsts, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("i")), "left")
    return joined.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def removals(rows: DataFrame) -> DataFrame:
    """``part, cells`` arrays of the parts that each task has seen, from ``part, mask, label`` rows.

    ``label`` has bit 0 for good and bit 1 for toxic documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts = np.zeros((0, MASKS, 4), np.int64)

        def flush() -> pa.RecordBatch:
            n = len(names)
            place = (np.arange(n)[:, None, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + FIRST  # part, mask, order
            cells = [counts.sum(axis=2)]
            for weights in (cells[0], counts[:, :, 1] + counts[:, :, 3], counts[:, :, 2] + counts[:, :, 3]):
                spread = np.broadcast_to(weights[:, :, None], place.shape)
                sums = np.bincount(place.ravel(), spread.ravel(), n * len(ORDERS) * (STEPS + 1))
                cells.append(sums.astype(np.int64).reshape(n, len(ORDERS), STEPS + 1)[:, :, :STEPS].reshape(n, CELLS))
            flat = np.concatenate(cells, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(list(names)), lists], ["part", "cells"])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = np.array([names.setdefault(p, len(names)) for p in parts.dictionary.to_pylist()], np.int64)
            cells = (codes[parts.indices.to_numpy()] * MASKS + batch.column(1).to_numpy()) * 4 + batch.column(2).to_numpy()
            counts = np.concatenate([counts, np.zeros((len(names) - len(counts), MASKS, 4), np.int64)])
            counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
            if len(names) >= PARTS:
                yield flush()
                names, counts = {}, counts[:0]
        if names:
            yield flush()

    return rows.select("part", "mask", "label").mapInArrow(run, "part string, cells array<bigint>")


def order_report(arrays: DataFrame) -> DataFrame:
    """Sums the tasks' arrays and gives a row for each part, order and step."""
    sums = arrays.select("part", F.posexplode("cells").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("at", "n")))["n"].alias("cells"))  # an array's cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, step = np.divmod(np.arange(CELLS), STEPS)
        own = np.argsort(PLACE, axis=1).ravel()  # the filter of each order and step
        bits = np.arange(MASKS)[:, None] >> np.arange(STEPS) & 1
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = cells.values.to_numpy()
                masks, (removed, good, toxic) = flat[:MASKS], flat[MASKS:].reshape(3, CELLS)
                kept = masks.sum() - removed.reshape(-1, STEPS).cumsum(axis=1).ravel()
                shapley = np.bincount(own, removed, STEPS).astype(np.int64)
                columns = [kept, removed, (masks @ bits)[own] - removed, masks[1 << np.arange(STEPS)][own], good, toxic, shapley[own]]
                head = [pa.array([part] * CELLS), pa.array([ORDERS[k] for k in order]), pa.array(step + 1, pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, columns)], [c.split(" ")[0] for c in REPORT.split(", ")])

    return whole.mapInArrow(run, REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, source, text), with ``labels`` (doc_id, quality, toxic)."""
    masks = with_copies(written(text_failures(docs), "filter-failures"))
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    known = labels.groupBy("doc_id").agg((flag("quality", 1) + flag("toxic", 2)).alias("label"))
    joined = masks.join(known, "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    return order_report(removals(joined))
