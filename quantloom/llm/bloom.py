"""Bloom filters sized by what they hold: built by Spark from a column of 64-bit names, tested in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import written

#: A filter has two to so many bits, at least and at most, and bits for each name below the most.
LEAST_BITS, MOST_BITS, PER_NAME = 20, 30, 64


def passes(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which unsigned names the filter may hold; one that it does hold always passes."""
    bits = (64 * len(words)).bit_length() - 1
    ok = np.ones(len(names), bool)
    for at in (names >> np.uint64(64 - bits), names >> np.uint64(8) & np.uint64((1 << bits) - 1)):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def holding(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose first column, a 64-bit name, the filter may hold."""
    for batch in batches:
        yield batch.filter(pa.array(passes(words, batch.column(0).to_numpy().view(np.uint64))))


def bloom(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the ``name`` column, as 64-bit words.

    Its size follows the number of names: about one in a thousand others passes, up to 16 million names.
    Beyond, at 128 MB, more of them pass (half of them at 660 million names): callers only lose time by it,
    since they tell apart what passed.
    """
    names = written(names.select("name"), "bloom-names")
    size = min(max((names.count() * PER_NAME).bit_length(), LEAST_BITS), MOST_BITS)
    name, mask = F.col("name"), F.lit((1 << size) - 1).cast("long")
    bits = names.select(F.explode(F.array(F.shiftrightunsigned(name, 64 - size), F.shiftrightunsigned(name, 8).bitwiseAND(mask))).alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = bits.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (size - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words
