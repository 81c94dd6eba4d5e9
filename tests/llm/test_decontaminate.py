"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from quantloom.llm.decontaminate import decontaminate, leak_report

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [] if text is None else WORD.findall(text.encode().lower())


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_report_matches_brute_force(spark, sf_dir, documents, small):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    want = brute(list(zip(small.doc_id.tolist(), small.text)), items)
    assert Counter(map(tuple, leak_report(documents, bench).collect())) == want
    assert any(r[5] for r in want)


def test_odd_rows(spark, odd, none):
    items = [("a", "one two three four five"), ("b", None), ("c", "..."), ("d", "number 7 jumps over a lazy dog and the quick brown fox"), (None, "one"), ("e", "five six seven")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute(rows, [(i, t) for i, t in items if i is not None])
    assert Counter(map(tuple, leak_report(odd, bench).collect())) == want
    assert leak_report(none, bench).count() == 0
    assert not any(r["contaminated"] for r in leak_report(odd, bench.where("1 = 0")).collect())


def test_many_automata_give_the_same(spark, odd):
    from quantloom.llm.decontaminate import find_leaks

    bench = spark.createDataFrame([(str(k), f"alpha beta{k} gamma") for k in range(40)] + [("x", "one two three"), ("y", "three four five")], "item_id string, text string")
    whole = {(r["doc_id"], str(r["__leak"])) for r in find_leaks(odd, bench).collect()}
    parts = {(r["doc_id"], str(r["__leak"])) for r in find_leaks(odd, bench, chunk_words=20).collect()}
    assert whole == parts and any("x" in r[1] for r in whole)


def test_stage_cuts_spans_and_drops_leaked_documents(spark, odd):
    bench = spark.createDataFrame([("a", "one two three four five"), ("b", "one")], "item_id string, text string")
    out = decontaminate(odd, bench)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert 4 not in rows and rows[5]["text"] == " six seven" and rows[5]["n_chars"] == 10
    assert rows[1]["text"] is None and rows[8]["text"] == "x" * 1000
