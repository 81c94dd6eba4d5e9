"""Suffix dedup, SimHash components and near copies against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import simhash
from quantloom.llm.bloom import bloom, holding, passes
from quantloom.llm.graph import components
from quantloom.llm.passages import WORDS
from quantloom.llm.simhash import simhash_components, split_hot, without_near_copies
from quantloom.llm.suffixes import LENGTH, PIECE, runs_of, without_repeats
from quantloom.llm.text import anchored_runs


def brute_repeats(texts):
    seen = Counter()
    data = [b"" if t is None else t.encode() for t in texts]
    for d in data:
        seen.update(hash(d[k : k + LENGTH]) for k in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - LENGTH + 1):
            if seen[hash(d[k : k + LENGTH])] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes_match_brute_force(documents, small):
    want = Counter(zip(small.doc_id.tolist(), brute_repeats(small.text)))
    got = Counter((r[0], tuple(r[1:5])) for r in without_repeats(documents).collect())
    assert got == want and sum(n for _, (_, n, _, _) in want) > 0


def test_suffixes_hold_little_memory_a_piece():
    rng = random.Random(3)
    text = bytes(rng.choices(b"abcdefgh ", k=PIECE // 16))
    tracemalloc.start()
    runs_of([text] * 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # two tasks run beside an executor's heap


def test_suffixes_pass_over_texts_seven_times(spark, documents):
    # two counts, two choices of runs, the bytes of runs chosen late, the names of chosen passages, and the removal
    docs, seen = documents.select("doc_id", "text"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = without_repeats(docs.mapInArrow(counted, docs.schema)).agg(F.sum("n_removed")).first()[0]
    assert got > 0 and 0 < seen.value <= 7 * docs.count()


def test_anchored_runs_match_plain_search():
    rng = np.random.default_rng(4)
    window, length = 5, 8
    for lengths in ([], [0], [7, 0], [8], [0, 30, 0, 0, 9, 7, 200, 0], [50] * 9):
        ends = np.cumsum([0, *lengths])
        n = int(ends[-1])
        key = np.full(-(-(n + window) // window) * window, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        want = []
        for text, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            for start in range(a, b - length + 1):
                anchor = min(key[start : start + window].tolist()) & 0xFFFFFFFF
                if want and want[-1][0] == text and want[-1][3] == anchor:
                    want[-1][2] = start
                else:
                    want.append([text, start, start, anchor])
        assert anchored_runs(key.copy(), ends, window, length).tolist() == want


def test_only_rows_that_the_filter_may_hold_are_kept(spark):
    words = bloom(spark.range(500).selectExpr("xxhash64(id) AS name"))
    own = [r["name"] for r in spark.range(500).selectExpr("xxhash64(id) AS name").collect()]
    others = [r["name"] for r in spark.range(10_000, 12_000).selectExpr("xxhash64(id) AS name").collect()]
    batch = pa.RecordBatch.from_pydict({"k1": own + others, "text": [str(k) for k in range(2500)]})
    kept = pa.Table.from_batches(holding(iter([batch, batch.slice(0, 0)]), words))
    assert kept.column("text").to_pylist()[:500] == [str(k) for k in range(500)] and kept.num_rows < 600


def test_suffixes_odd_rows(spark, odd, none):
    # offsets of equal strings that differ from copy to copy, and overlapping repeats
    base = "".join(f"passage {k} of a text; " for k in range(60))
    rows = odd.select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(20, "ab" + base[:700]), (21, base[100:900] + "z"), (22, base[:399]), (23, base[50:450])]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, own) for (i, _), own in zip(rows, brute_repeats([t for _, t in rows]))]
    assert Counter((r[0], tuple(r[1:5])) for r in got) == Counter(want)
    assert without_repeats(none).count() == 0


def test_shared_anchors(spark):
    deal = random.Random(3)
    passage = " ".join(deal.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(deal.randrange(999)) for _ in range(45))
    assert 300 < len(passage) < LENGTH
    rows = [(k, " ".join(str(deal.random()) for _ in range(80)) + (f" {passage} " if k % 4 == 0 else " ") + " ".join(str(deal.random()) for _ in range(80))) for k in range(40)]
    found = {r["doc_id"]: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["n_removed"] == 0 for r in found.values())
    assert {k for k, r in found.items() if r["n_shared"]} == {k for k in range(40) if k % 4 == 0}


def brute_copied(texts):
    own = [[tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)] for w in ((t or "").encode().split() for t in texts)]
    holders = Counter(p for ps in own for p in set(ps))
    return [sum(holders[p] > 1 for p in ps) for ps in own]


def test_copied_passages_match_brute_force(spark, documents, odd, small):
    want = Counter(zip(small.doc_id.tolist(), brute_copied(small.text)))
    got = Counter((r["doc_id"], r["n_copied"]) for r in without_repeats(documents).collect())
    assert got == want and sum(n > 0 for _, n in want) > 0

    deal = random.Random(5)
    words = lambda n, most=999: [deal.choice("abcdefgh") + str(deal.randrange(most)) for _ in range(n)]
    base, again = words(150), words(60)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for n in (50, 51, 52):  # texts of under LENGTH bytes, at the border of what counts
        passage = words(n, 9)
        rows += [(100 + n, " ".join(passage)), (200 + n, "\n ".join([*words(70), *passage, "end"]))]
    rows += [(300, " ".join(again + words(9) + again)), (301, " ".join(words(5) + ["x"] * 80)), (302, " ".join(again[:50]))]  # within one text only
    rows += [(k, " ".join(base)) for k in (400, 401)] + [(402, "\t".join(words(20) + base[30:101] + words(20))), (403, " ".join(base[100:]))]  # whole copies and parts of them
    rows += [(500 + k, " ".join(words(20) + base[70:125] + words(20))) for k in range(20)] + [(600, " ".join(base[5:])), (600, " ".join(base[5:]))]
    want = Counter(zip((i for i, _ in rows), brute_copied([t for _, t in rows])))
    got = Counter((r["doc_id"], r["n_copied"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 5000, 200_000])
def test_filters_hold_their_names_and_few_others(spark, n):
    names = spark.range(n).selectExpr("xxhash64(id) AS name")
    words = bloom(names)
    own = np.array([r["name"] for r in names.collect()], np.int64).view(np.uint64)
    assert passes(words, own).all()
    others = np.random.default_rng(n).integers(0, 1 << 63, 100_000, dtype=np.int64).view(np.uint64)
    assert passes(words, others).mean() < 0.01


def brute_fingerprint(text):
    words = b"" if text is None else text.encode().lower()
    words = words.split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, f"{p:016x}", min(least[find(k)], default=None)) for k, (i, p) in enumerate(prints))


def test_simhash_matches_brute_force(documents, small, odd, none):
    got = Counter(map(tuple, simhash_components(documents).collect()))
    assert got == brute_components(list(zip(small.doc_id.tolist(), small.text)))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, simhash_components(odd).collect())) == brute_components(rows)
    assert simhash_components(none).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    """Ids that stay: the smallest of each group of texts linked at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    texts = {}
    for k, (_, t) in enumerate(rows):
        union(k, texts.setdefault((t or "") if sets[k] else None, k))
    for a, own in enumerate(sets):
        for b, n in Counter(k for x in own for k in by[x] if k < a).items():
            if n >= 0.8 * (len(own) + len(sets[b]) - n):
                union(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append((i is None, i or 0))
    return sorted(min(x) for x in least.values())


def test_a_hot_shard_of_fingerprints_is_spread(spark):
    """100,000 fingerprints that agree on two blocks, 500 of them copied with one to four bits changed."""
    rng = np.random.default_rng(6)
    bits = np.unique(rng.integers(0, 1 << 42, 100_000, dtype=np.uint64) << np.uint64(22) | np.uint64(5))
    chosen = rng.choice(len(bits), 500, replace=False)
    near = [int(bits[k]) ^ sum(1 << int(b) for b in rng.choice(np.arange(22, 64), 1 + k % 4, replace=False)) for k in chosen]
    rows = pd.DataFrame({"key": 1, "bits": np.concatenate([bits, np.array(near, np.uint64)]).view(np.int64)}).drop_duplicates()
    finer = simhash.finer_shards(spark.createDataFrame(rows))
    sizes = finer.groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 2000 and sizes[1] == 5 * len(rows)
    edges = simhash.shard_links(finer).toPandas()
    assert max((int(a) ^ int(b)).bit_count() for a, b in zip(edges["a"].astype(np.int64).to_numpy().view(np.uint64), edges["b"].to_numpy().view(np.uint64))) <= 4
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges)).collect()}
    signed = np.array(near, np.uint64).view(np.int64).tolist()
    assert all(root[int(a)] == root[b] for a, b in zip(bits[chosen].view(np.int64), signed))


@pytest.mark.parametrize("limit", [1, 3])
def test_finer_shards_keep_every_link(documents, limit):
    rows = simhash.fingerprints(documents, 4).select("bits").distinct().withColumn("key", F.explode(simhash._shard_keys(F.col("bits"))))

    def roots(shards):
        return {r["node"]: r["root"] for r in components(simhash.shard_links(shards)).collect()}

    assert roots(simhash.finer_shards(rows, limit)) == roots(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = without_near_copies(docs)
    assert out.columns == docs.columns
    got, want = {r["doc_id"] for r in out.collect()}, {i for _, i in kept_by_brute_force(rows)}
    assert got == want


def test_near_copies_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = without_near_copies(odd)
    assert got.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == kept_by_brute_force(rows)
    assert without_near_copies(none).count() == 0


def test_hot_shards_keep_every_meeting(spark):
    shards = spark.range(90).selectExpr("7L shard", "cast(cast(id as string) as binary) key", "id low", "id high")
    dealt = split_hot(shards, 20).toPandas()
    together = defaultdict(set)
    for shard, key in zip(dealt.shard, dealt.key.map(bytes)):
        together[shard].add(key)
    pairs = {(a, b) for own in together.values() for a in own for b in own if a < b}
    assert len(pairs) == 90 * 89 // 2


@pytest.mark.parametrize(("words", "least", "most"), [(204, 1, 4), (104, 1, 2)])
def test_large_groups_around_the_similarity(spark, words, least, most):
    # 400 texts of one template, most pairs between 0.75 and 0.9: close candidates often fail, links farther off hold
    deal = random.Random(words)
    template = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(400):
        own = list(template)
        for at in deal.sample(range(words), deal.randint(least, most)):
            own[at] = f"x{deal.random()}"
        rows.append((k, " ".join(own)))
    got = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((False, r["doc_id"]) for r in got.collect()) == kept_by_brute_force(rows)
