"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its UTF-8 bytes and one end byte; a byte is eight binary decisions. For each of ``ORDERS`` so
many preceding bytes and the bits so far hash to a slot with counts of zeros and ones, gathered by
Spark from all training documents. The slots' log-odds are mixed by weights that a gate selects (bit
position, and the longest context seen in training), and the mixture is refined by an adaptive
probability map. Weights and map are fitted online on all training documents too, by Spark tasks, each
over its share in pieces of at most one in ``FIT_SHARES`` of all their bytes. A piece's own counts are
left out of the slots while it is fitted, and its equal strings are learned at once, by their number.
The means by bytes of what the tasks have learned are taken.

Contexts beyond the slots are held in a Spark table that grows with the corpus. A text is cut into
chunks behind blanks chosen by a hash; a chunk hangs on the ``REACH`` bytes before it. One more
binary decision says whether a chunk is one that training has behind these bytes: its predictor's
context is what the decisions before it in the text were (``STATES``). Such a chunk then costs its
share of what follows these bytes in training, any other its bytes. A training document's own
occurrence is left out, so that a text which occurs once is scored as a new one.

When texts are scored the model is fixed, so a score doesn't depend on the order of rows; as a byte's
probability depends on it and a few bytes before it, each such string is scored once a piece.

The base score of the same pass is a unigram model over words. Common words and chunks, at most
``HEAD_WORDS`` and ``HEAD``, are broadcast; all others are joined with the counts.

Defined cases: null is an empty text, which has the end token alone; repeated rows count again and
give repeated rows; without training documents every count is zero and the first weights are kept; a
single training document fits what contexts never seen cost; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .language import fold
from .storage import written
from .text import in_batches, pieces, utf8

#: Context lengths in bytes, and bits of the slot number of each.
ORDERS, SLOT_BITS = (1, 2, 3, 5), 20
#: Counters that travel in one row, bytes that a task works on at once and that its counters hold at most, word counts it holds, codes scored at once.
ROW, PIECE, HELD_BYTES, HELD_WORDS, BLOCK = 16, 8 << 20, 1 << 31, 1_000_000, 1 << 16
#: Pieces that weights and map are fitted in, at least, where texts allow it; most words, and most chunks, that are broadcast.
FIT_SHARES, HEAD_WORDS, HEAD = 8, 1 << 18, 1 << 17
#: Blanks in a boundary of chunks, bytes before a chunk that it hangs on, and what came before: no chunk, none copied, one or more copied.
CUT, REACH, STATES = 32, 16, 4
#: Count added to zeros and ones, the learning rates of weights and map, bytes that a batch counts as, distinct strings in it, buckets of the map.
PRIOR, RATE, MAP_RATE, BATCH, BATCH_CODES, BUCKETS = 0.4, 0.06, 0.02, 2048, 8192, 24
END, _START = b"\xff", b"\n" * 7
_SLOTS = 1 << SLOT_BITS
_INPUTS = len(ORDERS) + 1
_GATES = 8 * _INPUTS
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased and cut at 09-0D and 20, and where each text's begin and end among them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))  # none of these decodes bytes
    found = split.values.view(pa.binary())
    filled = pc.not_equal(found, b"").to_numpy(zero_copy_only=False)  # blanks at an end leave an empty one
    ends = np.concatenate(([0], np.cumsum(filled)))[split.offsets.to_numpy()]
    return found.filter(pa.array(filled)), ends


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte below the bytes before it, as many as contexts reach; and the texts' lengths."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = b"".join(itertools.chain.from_iterable((_START, t, END) for t in texts))
    whole = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    first = np.cumsum(lengths + 7) - lengths - 7
    inside = np.ones(len(whole), bool)
    inside[(first[1:, None] + np.arange(-7, 0)).ravel()] = False
    code, n = np.empty(int(lengths.sum()), np.uint64), 0
    for k in range(0, len(whole), BLOCK):  # so that there is only one array of all codes
        part = whole[k : k + BLOCK][inside[k : k + BLOCK]]
        code[n : n + len(part)] = part
        n += len(part)
    code &= np.uint64((1 << 8 * max(ORDERS) + 8) - 1)
    return code, lengths


def _bit(code: np.ndarray, bit: int) -> np.ndarray:
    return ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


def _slots(code: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each bit of the byte: the slots of order number ``k``."""
    byte, context = code & np.uint64(255), (code >> np.uint64(8)) & np.uint64((1 << 8 * ORDERS[k]) - 1)
    h = (context + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for bit in range(8):
        mark = ((byte | np.uint64(256)) >> np.uint64(8 - bit)) * np.uint64(0xD6E8FEB86659FD93)
        yield (((h ^ mark) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _unique(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct code stands among them, and the distinct codes."""
    import pandas as pd

    return pd.factorize(code)


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and how often each occurs; ``code`` is sorted in place."""
    code.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), code[1:] != code[:-1])))
    return code[first], np.diff(np.append(first, len(code)))


def _reduced(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_unique`` of what order number ``k`` sees of distinct codes: its bytes and the byte itself."""
    if ORDERS[k] == max(ORDERS):
        return np.arange(len(code)), code
    return _unique(code & np.uint64((1 << 8 * ORDERS[k] + 8) - 1))


def _add(counts: np.ndarray, code: np.ndarray, times: np.ndarray) -> None:
    """Adds codes, each so many times, to (orders, slots, 2) counts."""
    for k, own in enumerate(counts):
        at, seen = _reduced(code, k)
        n = np.bincount(at, weights=times).astype(own.dtype)
        flat = own.reshape(-1)
        for bit, slots in enumerate(_slots(seen, k)):
            np.add.at(flat, 2 * slots + _bit(seen, bit), n)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))).astype(np.float32)


@dataclass
class Mixer:
    """Log-odds by order and slot (zero: unseen), gated weights with a bias, and the probability map."""

    odds: np.ndarray | None
    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls, odds: np.ndarray | None = None) -> Mixer:
        weights = np.full((_GATES, _INPUTS), 0.35, np.float32)
        weights[:, -1] = 0
        grid = np.linspace(-8, 8, BUCKETS)
        return cls(odds, weights, np.tile(1 / (1 + np.exp(-grid)), (_GATES, 1)))

    @staticmethod
    def _inputs(reduced: list[tuple[np.ndarray, np.ndarray]], look: Callable[[int, np.ndarray, int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bit: the log-odds of all orders and the bias as an (orders + 1, n) array, and the longest order seen.

        ``reduced`` has what each order sees; ``look`` gives the log-odds of an order's number, slots and bit.
        """
        n = len(reduced[0][0])
        for bit, slots in enumerate(zip(*(_slots(seen, k) for k, (_, seen) in enumerate(reduced)))):
            given = np.ones((_INPUTS, n), np.float32)
            longest = np.zeros(n, np.int8)
            for k, (s, (at, _)) in enumerate(zip(slots, reduced)):
                np.take(look(k, s, bit), at, out=given[k], mode="clip")
                longest[given[k] != 0] = k + 1
            yield given, longest.astype(np.intp)

    def _mix(self, bit: int, given: np.ndarray, longest: np.ndarray) -> np.ndarray:
        every = self.weights[bit * _INPUTS : (bit + 1) * _INPUTS] @ given
        return np.clip(np.take(every.reshape(-1), longest * len(longest) + np.arange(len(longest))), np.float32(-7.99), np.float32(7.99))

    @staticmethod
    def _place(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (mixed + np.float32(8)) * np.float32((BUCKETS - 1) / 16)
        low = at.astype(np.intp)
        return low, at - low.astype(np.float32)

    def learn(self, code: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """One online pass over distinct codes, each so many times, which are left out of ``counts``.

        Each batch is predicted, then weights and map follow its errors. Neighbours should share no contexts, so sorted codes are to be shuffled before.
        """
        reduced = [_reduced(code, k) for k in range(len(ORDERS))]
        own = [np.bincount(at, weights=times).astype(np.float32) for at, _ in reduced]
        mine = np.zeros(2 * _SLOTS, np.float32)
        times = times.astype(np.float64)

        def both(all_counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
            return np.take(all_counts.reshape(-1).view(np.int64), slots).view(np.float32).reshape(-1, 2)  # zeros and ones lie side by side

        def left(k: int, slots: np.ndarray, bit: int) -> np.ndarray:
            at = 2 * slots + _bit(reduced[k][1], bit)
            np.add.at(mine, at, own[k])
            odds = _odds(*np.maximum(both(counts[k], slots) - both(mine, slots), 0).T)
            mine[at] = 0
            return odds

        for bit, (given, longest) in enumerate(self._inputs(reduced, left)):
            value = _bit(code, bit).astype(np.float32)
            first = bit * _INPUTS
            weights, refined = self.weights[first : first + _INPUTS], self.refined[first : first + _INPUTS]
            for start in range(0, len(code), BATCH_CODES):
                part = slice(start, start + BATCH_CODES)
                x, gate, one, n = given[:, part], longest[part], value[part], times[part]
                n = n * (min(BATCH, n.sum()) / n.sum())
                mixed = self._mix(bit, x, gate)
                error = n * (one - 1 / (1 + np.exp(-mixed)))
                here = np.maximum(np.bincount(gate, weights=n, minlength=_INPUTS), 1)
                chosen = np.where(gate == np.arange(_INPUTS)[:, None], error, 0).astype(np.float32)
                weights += np.float32(RATE) * (chosen @ x.T) / here[:, None].astype(np.float32)
                low, share = self._place(mixed)
                cell = gate * BUCKETS + low
                size, ones = np.zeros(refined.size + 1), np.zeros(refined.size + 1)
                for at, w in ((cell, n * (1 - share)), (cell + 1, n * share)):
                    size += np.bincount(at, weights=w, minlength=len(size))
                    ones += np.bincount(at, weights=w * one, minlength=len(size))
                size, ones = (x[:-1].reshape(refined.shape) for x in (size, ones))
                refined += np.minimum(1, MAP_RATE * size) * (ones / np.maximum(size, 1e-9) - refined)
        np.clip(self.refined, 1 / 4096, 1 - 1 / 4096, out=self.refined)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of each code's byte given the bytes before it, in blocks that stay in a processor's cache."""
        return np.concatenate([np.zeros(0), *(self._block(code[k : k + BLOCK]) for k in range(0, len(code), BLOCK))])

    def _block(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        for bit, (given, longest) in enumerate(self._inputs([_reduced(code, k) for k in range(len(ORDERS))], lambda k, slots, bit: self.odds[k][slots])):
            mixed = self._mix(bit, given, longest)
            low, share = self._place(mixed)
            own = self.refined[bit * _INPUTS : (bit + 1) * _INPUTS].astype(np.float32).ravel()
            cell = longest * BUCKETS + low
            mapped = own[cell] * (1 - share) + own[cell + 1] * share
            p = (1 / (1 + np.exp(-mixed)) + mapped) / 2
            out += np.log10(np.where(_bit(code, bit), p, 1 - p))
        return out


def _cuts(code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions among ``code`` at which a chunk starts: each text's first, and those behind a chosen blank."""
    blanks = np.flatnonzero(_BLANK[code.view(np.uint8)[::8]])  # the low byte, as numbers are little-endian
    chosen = (code[blanks] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(CUT - 1) == 0
    start = np.zeros(len(code) + 1, bool)
    start[blanks[chosen] + 1] = True
    start[np.cumsum(lengths) - lengths] = True
    return np.flatnonzero(start[:-1])


def _chunks(texts: list[bytes], lengths: np.ndarray, start: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk: the name of it with the bytes it hangs on, the name of those (if ``whole``), and its text's number."""
    from xxhash import xxh3_64_intdigest

    first = np.cumsum(lengths) - lengths
    owner = np.searchsorted(first, start, "right") - 1
    local = (start - first[owner]).tolist()
    names, before = [], []
    last = len(local) - 1
    for k, (i, a) in enumerate(zip(owner.tolist(), local)):
        text = texts[i]
        b = local[k + 1] if k < last and local[k + 1] else len(text) + 1
        low = a - REACH if a > REACH else 0
        names.append(xxh3_64_intdigest(text[low:b], b > len(text)))
        if whole:
            before.append(xxh3_64_intdigest(text[low:a], a == 0))
    return np.array(names, np.uint64).view(np.int64), np.array(before, np.uint64).view(np.int64), owner


def gather(docs: DataFrame) -> DataFrame:
    """Counts of training texts: rows of words (``END`` for ends) and their numbers, of a piece's chunks, or of a run of slots with all counters."""
    names = [f"n{k}" for k in range(2 * ROW)]
    columns = ["words", "times", "chunks", "before", "run", *names]
    kinds = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, *[pa.int32()] * (1 + 2 * ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ORDERS), _SLOTS, 2), np.int32)
        words, size = pa.table({"words": pa.array([END], pa.binary()), "n": pa.array([0])}), 0

        def lists(**own: pa.Array) -> pa.RecordBatch:
            made = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in own.items()}
            return pa.RecordBatch.from_arrays([made.get(c, pa.nulls(1, k)) for c, k in zip(columns, kinds)], columns)

        def word_row() -> pa.RecordBatch:
            return lists(**{c: x.combine_chunks() for c, x in zip(("words", "times"), merged(words).columns)})

        def merged(parts: pa.Table) -> pa.Table:
            return parts.group_by("words", use_threads=False).aggregate([("n", "sum")]).rename_columns(["words", "n"])

        def slot_rows() -> Iterator[pa.RecordBatch]:
            rows = counts.reshape(-1, 2 * ROW)
            used = np.flatnonzero(rows.any(1))
            for k in range(0, len(used), 16384):
                own = used[k : k + 16384]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(own), k) for k in kinds[:4]), pa.array(own, pa.int32()), *(pa.array(c) for c in np.ascontiguousarray(rows[own].T))], columns)
            counts[:] = 0

        for _, texts in pieces(batches, "text", PIECE):
            seen, n = pc.value_counts(_words(texts)[0]).flatten()
            words = pa.concat_tables([words, pa.table({"words": seen, "n": n}), pa.table({"words": pa.array([END], pa.binary()), "n": pa.array([len(texts)])})])
            if len(words) > HELD_WORDS:
                words = merged(words)
                if len(words) > HELD_WORDS // 2:
                    yield word_row()
                    words = words[:0]
            code, lengths = _codes(texts)
            chunks, before, _ = _chunks(texts, lengths, _cuts(code, lengths), True)
            yield lists(chunks=pa.array(chunks), before=pa.array(before))
            if size + len(code) > HELD_BYTES - 1:
                yield from slot_rows()
                size = 0
            size += len(code)
            _add(counts, *_counted(code))
        if size:
            if len(words):
                yield word_row()
            yield from slot_rows()

    return docs.select("text").mapInArrow(run, ", ".join(["words array<binary>", "times array<long>", "chunks array<long>", "before array<long>", "run int", *(f"{n} int" for n in names)]))


def _slot_counts(sums: DataFrame) -> np.ndarray:
    """Counts as (orders, slots, 2) from slot sums: as many rows as the model has runs, at most."""
    counts = np.zeros((len(ORDERS) * _SLOTS // ROW, 2 * ROW), np.float32)
    rows = sums.toArrow()
    at = rows.column("run").to_numpy()
    for k in range(2 * ROW):
        counts[at, k] = rows.column(f"n{k}").to_numpy()
    return counts.reshape(len(ORDERS), _SLOTS, 2)


def fitted(docs: DataFrame, counts: np.ndarray) -> Mixer:
    """The mixer with the means, by bytes, of the weights and maps that tasks fit to their shares of ``docs``, which ``counts`` count."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    limit = max(1, min(PIECE, int(counts[0].sum(dtype=np.float64)) // 8 // FIT_SHARES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Mixer.fresh(), 0
        for _, texts in pieces(batches, "text", limit):
            code, times = _counted(_codes(texts)[0])
            order = np.random.default_rng(len(code)).permutation(len(code))
            own.learn(code[order], times[order], shared.value)
            n += int(times.sum())
        if n:
            values = np.concatenate((own.weights.ravel(), own.refined.ravel())).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values * n), pa.array([n] * len(values))], ["cell", "value", "n"])

    mixer = Mixer.fresh(_odds(counts[..., 0], counts[..., 1]))
    rows = docs.select("text").mapInArrow(run, "cell long, value double, n long").groupBy("cell").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    shared.unpersist()
    if not rows:
        return mixer
    values = np.zeros(mixer.weights.size + mixer.refined.size)
    values[[r["cell"] for r in rows]] = [r["value"] / r["n"] for r in rows]
    weights, refined = np.split(values, [mixer.weights.size])
    return Mixer(mixer.odds, weights.astype(np.float32).reshape(mixer.weights.shape), refined.reshape(mixer.refined.shape))


def _level() -> Column:
    return F.floor(F.log2("n") * 4).cast("int")


def _head(counts: DataFrame, room: int = HEAD) -> tuple[int, int, int]:
    """The level (quarters of log2 of ``n``) from which on at most ``room`` rows lie, the sum of ``n``, and the rows."""
    levels = counts.groupBy(_level().alias("level")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    least = 1 << 30
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["rows"]
        if room < 0:
            break
        least = r["level"]
    return least, sum(r["n"] for r in levels), sum(r["rows"] for r in levels)


def copied(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """``row``, and for each state ``hit*``, ``miss*`` chunks, the ``bytes`` score of misses and the ``copies`` score of hits.

    ``scored`` has ``row, held_out`` and arrays ``chunks`` and ``chunk_scores``; ``chunks`` counts names (``n``) and what they hang on (``all``).
    """
    least, _, _ = _head(chunks)
    own = scored.select("row", "held_out", F.posexplode(F.arrays_zip("chunks", "chunk_scores")).alias("k", "c")).select("row", "held_out", "k", F.col("c.chunks").alias("name"), F.col("c.chunk_scores").alias("b"))
    near = own.join(F.broadcast(chunks.where(_level() >= least)), "name", "left")  # at most HEAD rows
    far = near.where("n IS NULL").drop("n", "all").join(chunks.where(_level() < least), "name", "left")
    rows = near.where("n IS NOT NULL").unionByName(far)
    mine = F.when(F.col("held_out"), 0).otherwise(1)
    rows = rows.select("row", "k", "b", (F.coalesce("n", F.lit(0)) > mine).alias("hit"), F.log10((F.col("n") - mine) / F.nullif(F.col("all") - mine, F.lit(0))).alias("q"))
    back = Window.partitionBy("row").orderBy("k")
    one, two = (F.lag("hit", d).over(back) for d in (1, 2))
    rows = rows.withColumn("state", F.when(one.isNull(), 0).when(~one, 1).when(~F.coalesce(two, F.lit(False)), 2).otherwise(3))
    counts = [F.count_if((F.col("state") == s) & h).alias(f"{n}{s}") for n, h in (("hit", F.col("hit")), ("miss", ~F.col("hit"))) for s in range(STATES)]
    return rows.groupBy("row").agg(*counts, F.sum(F.when(~F.col("hit"), F.col("b"))).alias("bytes"), F.sum(F.when(F.col("hit"), F.col("q"))).alias("copies"))


def score_report(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = in_batches(docs).select("doc_id", "text", (fold("doc_id", folds) == held_out).alias("held_out"))
    training = docs.where("NOT held_out")
    # a task's words and runs are nearly distinct, so that adding them up before they are dealt out would only cost time
    gathered = written(gather(training), "mixing-counts", {"parquet.enable.dictionary": "false"})
    words = written(gathered.where("words IS NOT NULL").select(F.inline(F.arrays_zip("words", "times"))).repartition("words").groupBy(F.col("words").alias("word")).agg(F.sum("times").alias("n")), "mixing-words")
    sums = gathered.where("run IS NOT NULL").repartition("run").groupBy("run").agg(*(F.sum(f"n{k}").cast("float").alias(f"n{k}") for k in range(2 * ROW)))
    pairs = gathered.where("chunks IS NOT NULL").select(F.inline(F.arrays_zip("chunks", "before"))).groupBy("before", "chunks").agg(F.count("*").alias("n"))
    pairs = written(pairs, "mixing-pairs")
    totals = written(pairs.groupBy("before").agg(F.sum("n").alias("all")), "mixing-totals")
    chunks = written(pairs.join(totals, "before").select(F.col("chunks").alias("name"), "n", "all"), "mixing-chunks")
    shared = spark.sparkContext.broadcast(fitted(training, _slot_counts(sums)))

    least, total, distinct = _head(words, HEAD_WORDS)
    below = total + 0.1 * (distinct + 1)
    head = words.where((_level() >= least) & (F.col("word") != F.lit(END))).toArrow()  # at most HEAD_WORDS rows
    ends = sum(r["n"] for r in words.where(F.col("word") == F.lit(END)).toLocalIterator())
    common = spark.sparkContext.broadcast((pa.concat_arrays(head.column("word").chunks or [pa.array([], pa.binary())]), np.append(np.log10((head.column("n").to_numpy() + 0.1) / below), 0)))
    end_log = math.log10((ends + 0.1) / below)
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mixer, (known, logs) = shared.value, common.value
        row = TaskContext.get().partitionId() << 40
        for part, texts in pieces(batches, "text", PIECE):
            code, lengths = _codes(texts)
            start = _cuts(code, lengths)
            at, distinct = _unique(code)
            del code  # as large as what follows
            names, _, owner = _chunks(texts, lengths, start, False)
            each = np.add.reduceat(mixer.log10(distinct)[at], start)
            del at
            ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (names, each)]
            words, split = _words(texts)
            place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            rare = place < 0
            sums = np.diff(np.concatenate(([0], np.cumsum(logs[place], dtype=np.longdouble)))[split]).astype(np.float64)
            behind = np.concatenate(([0], np.cumsum(rare)))[split]
            tails = pa.ListArray.from_arrays(pa.array(behind, pa.int32()), words.filter(pa.array(rare)))
            n_tokens = np.diff(split) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), part.column(0), part.column(2), pa.array(n_tokens), pa.array(n_tokens - 1 - np.diff(behind)), pa.array(sums), pa.array(lengths - 1), tails, *lists],
                ["row", "doc_id", "held_out", "n_tokens", "n_head", "head", "n_bytes", "tail", "chunks", "chunk_scores"],
            )
            row += len(texts)

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, head double, n_bytes long, tail array<binary>, chunks array<long>, chunk_scores array<double>"
    scored = written(docs.mapInArrow(run, schema), "mixing-scores")
    digest = F.hash("word").alias("digest")  # sorts faster than words do
    tail = scored.select("row", F.explode("tail").alias("word")).select("*", digest).join(words.where(_level() < least).select("*", digest), ["digest", "word"], "left")
    odds = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(below))
    tail = tail.groupBy("row").agg(F.sum(odds).alias("rest"), F.count("n").alias("n_rest"))
    known = written(scored.drop("tail", "chunks", "chunk_scores").join(copied(scored, chunks), "row"), "mixing-copies")
    cells = [f"{n}{s}" for s in range(STATES) for n in ("hit", "miss")]
    seen = known.where("NOT held_out").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells)).first()
    flags = F.lit(0.0)
    for s in range(STATES):
        hits, misses = seen[f"hit{s}"], seen[f"miss{s}"]
        flags += F.col(f"hit{s}") * math.log10((hits + 0.5) / (hits + misses + 1)) + F.col(f"miss{s}") * math.log10((misses + 0.5) / (hits + misses + 1))
    none = F.lit(0)
    out = known.join(tail, "row", "left").withColumn("score", flags + F.coalesce("bytes", F.lit(0.0)) + F.coalesce("copies", F.lit(0.0)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", none) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("rest", none) + F.lit(end_log)).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        sum((F.col(f"hit{s}") for s in range(STATES)), none).alias("n_copied"),
    )
