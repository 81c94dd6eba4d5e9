"""Benchmark decontamination with a generalised suffix automaton over the benchmark's words.

The automaton of all items is built on the driver from a bounded chunk of the benchmark and
broadcast; tasks stream document words through it, tracking the longest suffix that some item
contains. A suffix of ``window`` words or more is an occurrence of a window; an item shorter than
that counts as one window. A benchmark above ``chunk_words`` words is dealt into chunks, each with
an automaton of its own, and the documents pass them one after another, without a shuffle.

Defined cases: a null or word-free text has no words and no hits; an item without words or with a
null id is ignored; an item id on several rows is one item with the windows of all its rows;
repeated documents give repeated rows; an empty benchmark gives no hits.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM_TABLE, alnum_words, in_batches, unused, utf8

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items in which each window occurs."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                sequences.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])
        self._mark(sequences)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.edges) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for exactly the string that leads from ``p`` over ``w``."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(w) == q:
            self.edges[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.edges[last]:
            return self._split(last, self.edges[last][w], w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.edges[p]:
            self.edges[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.edges[p][w], w)
        return state

    def _mark(self, sequences: list[tuple[str, list[int]]]) -> None:
        """Give each window's state its items, and each state the short items that end there."""
        length, link, window = self.length, self.link, self.window
        self.window_state = [-1] * len(length)
        for v in sorted(range(1, len(length)), key=length.__getitem__):
            if length[v] >= window:
                self.window_state[v] = v if length[link[v]] < window else self.window_state[link[v]]
        self.items: dict[int, set[str]] = defaultdict(set)
        short: dict[int, set[tuple[int, str]]] = defaultdict(set)
        for item, ids in sequences:
            v = 0
            for w in ids:
                v = self.edges[v][w]
                if self.window_state[v] >= 0:
                    self.items[self.window_state[v]].add(item)
            if len(ids) < window:
                short[v].add((len(ids), item))
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        if short:
            for v in sorted(range(1, len(length)), key=length.__getitem__):
                own = self.short.get(link[v], ()) + tuple(sorted(short.get(v, ())))
                if own:
                    self.short[v] = own

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ``[start, end)`` word ranges inside windows, and the items of those windows."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocab or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        runs = [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= self.shortest]
        for a, b in runs:
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while state and w not in self.edges[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.edges[state].get(w, 0)
                matched = matched + 1 if state else 0
                hit = 0
                if matched >= self.window:
                    hit = self.window
                    found |= self.items[self.window_state[state]]
                for n, item in self.short.get(state, ()):
                    if n <= matched:
                        hit = max(hit, n)
                        found.add(item)
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _automata(benchmark: DataFrame, window: int, chunk_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton per chunk of at most about ``chunk_words`` words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = 1 + total // (4 * chunk_words)
    for k in range(chunks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        yield SuffixAutomaton(((r[0], alnum_words(r[1])) for r in own.toLocalIterator()), window)


#: What a scan finds in a document: words, merged word ranges (flat), items.
Leak = dict


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, chunk_words: int, finish: Callable[[pa.RecordBatch, list[Leak]], pa.RecordBatch] | None = None) -> DataFrame:
    """``docs`` with struct ``__leak``, or what ``finish`` makes of each batch without it and its leaks.

    The last automaton's pass finishes, so that a benchmark of one chunk takes one Python worker a core.
    """
    spark = docs.sparkSession
    plain, name = in_batches(docs), unused(docs, "__leak")
    out = plain.withColumn(name, F.lit(None).cast("struct<n_words:bigint,spans:array<bigint>,items:array<string>>"))

    def passed(df: DataFrame, automaton: SuffixAutomaton, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, to = batch.schema.get_field_index("text"), batch.num_columns - 1
                found = []
                for text, before in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist()):
                    words = alnum_words(text)
                    spans, items = shared.value.scan(words)
                    if before and before["spans"]:
                        old = before["spans"]
                        spans = merged([*spans, *zip(old[::2], old[1::2])])
                        items |= set(before["items"])
                    found.append({"n_words": len(words), "spans": list(itertools.chain(*spans)), "items": sorted(items)})
                if last and finish:
                    yield finish(batch.drop_columns([name]), found)
                else:
                    yield batch.set_column(to, batch.schema.field(to), pa.array(found, batch.schema.field(to).type))

        return df.mapInArrow(run, plain.schema if last and finish else df.schema)

    held = None
    for automaton in _automata(benchmark, window, chunk_words):
        out = passed(out, held, False) if held else out
        held = automaton
    return passed(out, held, True)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_words: int = 1_000_000) -> DataFrame:
    """``docs`` and a last column, a struct of ``n_words``, ``spans`` (flat word ranges) and ``items``; its name is ``__leak`` or one that ``docs`` doesn't have."""
    return _scan(docs, benchmark, window, chunk_words)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given word ranges and what stands between their words."""
    data = utf8(text)
    at = [m.span() for m in _WORD.finditer(data.translate(ALNUM_TABLE))]
    kept, end = [], 0
    for a, b in spans:
        kept.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, data[end:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, chunk_words: int = 1_000_000) -> DataFrame:
    """``docs`` with leaked spans cut from ``text``; a document with more than ``max_coverage`` of its words leaked goes.

    The columns are those of ``docs``; ``n_chars``, where present, follows the new text.
    """

    def finish(batch: pa.RecordBatch, leaks: list[Leak]) -> pa.RecordBatch:
        at, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
        hits = [sum(x["spans"][1::2]) - sum(x["spans"][::2]) for x in leaks]
        old = batch.column(at).to_pylist()
        new = [without_words(t, list(zip(x["spans"][::2], x["spans"][1::2]))) if h else t for t, x, h in zip(old, leaks, hits)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if n >= 0:
            counts = [len(t) if h else c for t, h, c in zip(new, hits, batch.column(n).to_pylist())]
            batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
        return batch.filter(pa.array([h <= max_coverage * x["n_words"] for h, x in zip(hits, leaks)], pa.bool_()))

    return _scan(docs, benchmark, window, chunk_words, finish).select(*docs.columns)


def _hit_words(spans):
    return F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("bigint"), lambda n, i: n + F.when(i % 2 == 0, -F.element_at(spans, (i + 1).cast("int"))).otherwise(F.element_at(spans, (i + 1).cast("int"))))


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, window)
    spans = F.col("__leak.spans")
    return found.select(
        "doc_id",
        F.coalesce("__leak.n_words", F.lit(0)).cast("long").alias("n_words"),
        F.when(F.size(spans) > 0, _hit_words(spans)).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size("__leak.items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__leak.items").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.size(spans) > 0, F.lit(False)).alias("contaminated"),
    )
