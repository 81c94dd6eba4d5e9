"""SimHash fingerprints and near-duplicate groups through BK-trees.

Links of 64-bit fingerprints are found exactly: with ``BLOCKS`` blocks and a radius of four, two
fingerprints that link agree on at least ``BLOCKS - 4`` whole blocks. Each distinct fingerprint
goes, by a shuffle, to one shard for each choice of that many blocks; a shard's members form a
BK-tree that all of them query. Shards are not broadcast, since their number and size follow the
data. A shard emits a spanning forest of its links, never all pairs, and the forests' components
are joined by star contraction.

``without_near_copies`` keeps one document of each group of near-duplicates by the Jaccard similarity of
word shingles. At a similarity of 0.8 about 15 % of fingerprint bits differ, too many for whole blocks
to agree, so its shards are keyed by bands of minimum hashes of the shingles; 128-bit fingerprints form
the shards' BK-trees, and the links that the trees find are checked exactly. First each shard offers a
forest and each member's nearest partners. Members whose other candidates were not offered are open;
where a shard's open members are still apart after the exact check, their shingles go to the shard and
every candidate between members that are apart is checked there.

Defined cases: null and word-free texts have fingerprint zero and link like any other; equal texts
share fingerprint and component; a document without id has a fingerprint, and the component of
the ids it reaches, null if none; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bktree import Forest, Links, distance
from .bloom import bloom, passes
from .graph import components
from .storage import written
from .text import in_batches, spaced_words, unused

#: Bits of the blocks of a 64-bit fingerprint, and the most differing bits of a link.
BLOCKS, RADIUS = (11, 11, 11, 11, 10, 10), 4
#: For near copies: bands of minimum hashes, hashes in a band, and the most of 128 bits that differ in a candidate.
BANDS, BAND_HASHES, WIDE_RADIUS = 7, 2, 36
#: Bits by which the radius grows while candidates are linked, and partners that each keeps besides.
RING, NEAREST = 6, 4
#: Rows of whole shards that a task joins at once; members beyond which a shard is dealt by further blocks.
CHUNK_ROWS, HOT_SHARD = 200_000, 20_000
#: Keys of hot shards that are broadcast, eight bytes each; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: For shards that carry shingles: rows joined at once, shingles beyond which a shard is dealt by its parts, candidates checked at once.
SET_ROWS, HOT_SET, CHECKED = 1024, 500_000, 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, repeats included; fewer words make one shingle."""
    from xxhash import xxh64_intdigest

    found = spaced_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    if len(found) <= words:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    starts = [0, *ends]
    return np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each one if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, bits``: the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([majority(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def whole_shards(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Chunks of complete shards of two rows or more, from batches sorted by their first column."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= limit:
            table = pa.concat_tables(held)
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held, rows = [table.slice(cut)], table.num_rows - cut
    if rows:
        yield pa.concat_tables(held)


def _crowded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys that occur twice or more, and their group numbers."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(size[group] > 1)
    return at, group[at]


def finer_shards(shards: DataFrame, limit: int = HOT_SHARD) -> DataFrame:
    """``key, bits`` rows, those of hot shards dealt by Spark to five finer ones each, one for each of five blocks of all 64 bits.

    Five blocks and a radius of four: a pair that links agrees on one block at least, so still meets. Keys
    are hashes of shard and block; should two be equal, their members only meet in vain.
    """
    hot = written(shards.groupBy("key").count().where(F.col("count") > limit).select("key"), "hot-shards")
    n = hot.count()
    if not n:
        return shards
    own = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    # interleaved blocks: bits k, k + 5, k + 10 ..., so that the bits a shard shares anyway are spread over all five
    masks = [sum(1 << b for b in range(k, 64, 5)) for k in range(5)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    finer = F.array(*(F.xxhash64("key", F.lit(k), F.col("bits").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)))
    return shards.join(own, "key", "left_anti").select("key", "bits").unionByName(shards.join(own, "key").select(F.explode(finer).alias("key"), "bits"))


def shard_links(shards: DataFrame) -> DataFrame:
    """``a, b`` edges that connect linked fingerprints, from ``key, bits`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_shards(batches):
            at, group = _crowded(chunk.column("key").to_numpy())
            bits = chunk.column("bits").to_numpy()[at].view(np.uint64)
            links = Links(len(bits))
            for i, j, d in Forest(bits.reshape(-1, 1), group).pairs(RADIUS):
                links.add(i, j, d)
            edges = bits.view(np.int64)[links.edges()]
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return shards.repartition("key").sortWithinPartitions("key").select("key", "bits").mapInArrow(run, "a long, b long")


def _shard_keys(bits: Column) -> Column:
    offsets = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key = F.lit(n).cast("long")
        for k in chosen:
            value = F.shiftrightunsigned(bits, offsets[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1).cast("long"))
            key = F.shiftleft(key, BLOCKS[k]).bitwiseOR(value)
        keys.append(key)
    return F.array(*keys)


def simhash_components(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document; fingerprints link at ``RADIUS`` differing bits or fewer."""
    rows = written(fingerprints(docs, words), "simhash")
    distinct = rows.groupBy("bits").agg(F.min("doc_id").alias("first"))
    links = shard_links(finer_shards(distinct.select("bits", F.explode(_shard_keys(F.col("bits"))).alias("key"))))
    linked = components(links).withColumnRenamed("node", "bits")
    linked = linked.join(distinct, "bits")
    roots = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(roots, "root").select("bits", "least")
    known = distinct.join(linked, "bits", "left").select("bits", F.coalesce("least", "first").alias("component_id"))
    known = written(known, "simhash-known")  # a plain table, so that adaptive execution may split the join where many texts share a fingerprint
    return rows.join(known, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    x = (hashes ^ np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band: a hash of its minimum hashes."""
    least = [_mixed(hashes, k + 1).min() if len(hashes) else np.uint64(0) for k in range(BANDS * BAND_HASHES)]
    keys = np.array(least, np.uint64).reshape(BANDS, BAND_HASHES)
    total = np.arange(BANDS, dtype=np.uint64)
    for column in keys.T:
        total = _mixed(total ^ column, 99)
    return total.view(np.int64).tolist()


def _wide_rows(docs: DataFrame, words: int) -> DataFrame:
    """``key, doc_id, low, high, bands`` of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, bands = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(text, words))
                low.append(majority(hashes))
                high.append(majority(_mixed(hashes, 0)))
                bands.append(band_keys(hashes))
            halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *halves, pa.array(bands, pa.list_(pa.int64()))], ["key", "doc_id", "low", "high", "bands"])

    return in_batches(docs).select("__key", "doc_id", "text").mapInArrow(run, f"key binary, doc_id {kind}, low long, high long, bands array<bigint>")


def split_hot(shards: DataFrame, limit: int = HOT_SHARD, weight: str = "1") -> DataFrame:
    """``shards`` with each hot one (of over ``limit`` in weights) dealt to shards of its own for every two of its parts, so that any two members still meet."""
    sizes = shards.groupBy("shard").agg(F.sum(F.expr(weight)).alias("n")).where(F.col("n") > limit)
    sizes = written(sizes.select("shard", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot-shards")
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("shard", F.least(own, j.cast("long")), F.greatest(own, j.cast("long"))))
    hot = shards.join(sizes, "shard").withColumn("shard", F.explode(met)).drop("parts")
    return shards.join(sizes, "shard", "left_anti").unionByName(hot)


def near_links(shards: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """``a, b`` keys of candidates: of each shard, a spanning forest that prefers close pairs, and each member's nearest partners.

    A member with candidates beyond these is a row of its key ``a``, its ``shard`` and no ``b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_shards(batches):
            at, group = _crowded(chunk.column("shard").to_numpy())
            bits = np.stack([chunk.column(c).to_numpy()[at].view(np.uint64) for c in ("low", "high")], 1)
            links, forest, found = Links(len(bits), NEAREST), Forest(bits, group), np.zeros(len(bits), np.int64)
            steps = [-1, *range(RING, radius, RING), radius]
            for above, most in zip(steps, steps[1:]):
                for i, j, d in forest.pairs(most, above):
                    links.add(i, j, d)
                    np.add.at(found, i, 1)
                    np.add.at(found, j, 1)
            edges = links.edges()
            still = at[found > np.bincount(edges.ravel(), minlength=len(bits))]
            keys, where = chunk.column("key"), chunk.column("shard").take(pa.array(still))
            pairs = {c: keys.take(pa.array(at[edges[:, k]])) for k, c in enumerate("ab")}
            yield from pa.table({**pairs, "shard": pa.nulls(len(edges), pa.int64())}).to_batches()
            yield from pa.table({"a": keys.take(pa.array(still)), "b": pa.nulls(len(still), pa.binary()), "shard": where}).to_batches()

    rows = shards.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "key", "low", "high")
    return rows.mapInArrow(run, "a binary, b binary, shard long")


def _verified(bits: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links at ``similarity`` or more that connect members of one shard whose labels differ; each candidate between members still apart is checked."""
    sizes, out = np.array([len(x) for x in sets], np.int64), []
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(len(flat), bool)
    for i in range(1, len(bits)):
        far = distance(bits[:i], bits[i])
        near = np.flatnonzero((far <= radius) & (label[:i] != label[i]) & (np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i])))
        if not len(near):
            continue
        near = near[np.argsort(far[near], kind="stable")]
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        while len(near):
            now, near = near[:CHECKED], near[CHECKED:]
            n = sizes[now]
            hits = mark[flat[np.repeat(ends[now] - np.cumsum(n), n) + np.arange(n.sum())]]
            common = np.diff(np.concatenate(([0], np.cumsum(hits)))[np.concatenate(([0], np.cumsum(n)))])
            for j in now[common >= similarity * (sizes[i] + n - common)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
            near = near[label[near] != label[i]]
        mark[own] = False
    return out


def open_links(shards: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``a, b`` keys of links, from ``shard, key, root, low, high, hashes`` rows of members; links within a root are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_shards(batches, SET_ROWS):
            at, group = _crowded(chunk.column("shard").to_numpy())
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = chunk.slice(int(at[start]), end - start).combine_chunks()
                bits = np.stack([own.column(c).to_numpy().view(np.uint64) for c in ("low", "high")], 1)
                label = np.unique(np.array(own.column("root").to_pylist(), object), return_inverse=True)[1]
                sets = [x.to_numpy() for x in (v.values for v in own.column("hashes"))]
                pairs = np.array(_verified(bits, label, sets, radius, similarity), np.int64).reshape(-1, 2)
                yield from pa.table({c: own.column("key").take(pa.array(pairs[:, k])) for k, c in enumerate("ab")}).to_batches()

    rows = shards.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "key", "root", "low", "high", "hashes")
    return rows.mapInArrow(run, "a binary, b binary")


def _shingle_sets(keyed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``key, hashes``: the distinct shingle hashes of each text in ``wanted`` (key, doc_id).

    A filter of the wanted tells which texts to take, so no other text is shuffled.
    """
    name = F.xxhash64("__key", "doc_id")
    shared = keyed.sparkSession.sparkContext.broadcast(bloom(wanted.select(name.alias("name"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(passes(shared.value, batch.column(1).to_numpy().view(np.uint64))))
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in own.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    found = keyed.select("__key", name.alias("name"), "text").mapInArrow(run, "key binary, hashes array<bigint>")
    return found.dropDuplicates(["key"])


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, root`` of texts (by MD5) that are linked to others at ``similarity`` or more; root is the smallest key."""
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__key"), "doc_id", "text")
    rows = written(_wide_rows(keyed, words), "near-rows")
    distinct = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("bands").alias("bands"))
    shards = distinct.select("key", "low", "high", F.explode("bands").alias("shard"))
    offered = written(near_links(split_hot(shards)), "near-offered")
    pairs = written(offered.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = distinct.join(ends, "key", "left_semi").select(F.col("key").alias("__key"), "doc_id")
    sets = written(_shingle_sets(keyed, wanted, words), "near-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    linked = components(both.where((common >= F.lit(similarity) * union)).select("a", "b")).toDF("key", "root")
    members = offered.where("b IS NULL").select("shard", F.col("a").alias("key")).join(linked, "key", "left")
    members = written(members.select("shard", "key", F.coalesce("root", "key").alias("root")), "near-open")
    apart = members.groupBy("shard").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shard")
    members = members.join(apart, "shard", "left_semi")
    if members.isEmpty():
        return linked
    members = members.join(distinct.select("key", "low", "high"), "key").join(sets, "key")
    more = open_links(split_hot(members, HOT_SET, "size(hashes)"), WIDE_RADIUS, similarity)
    return components(linked.toDF("a", "b").union(more)).toDF("key", "root")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest doc_id (nulls last).

    Texts without words are one group; a group is what links of ``similarity`` or more
    connect. Of repeated rows, equal in doc_id and text, one stays.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    copies = docs.select(key.alias("key"), "doc_id").groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"), F.col("n"))
    best = copies.groupBy("key").agg(F.min(order).alias("best"))
    groups = near_groups(docs, words, similarity)
    best = best.join(groups, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    best = written(best.select(F.col("best.key").alias("__key"), F.col("best.doc_id").alias("__id"), F.col("best.n").alias("__n")), "near-kept")
    stays = (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    # repeated rows count as gone here, so that the join below decides on them
    gone = copies.join(best.where("__n = 1"), stays, "left_anti").select(F.xxhash64("key", "doc_id").alias("name"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(gone))

    @F.pandas_udf("boolean")
    def doubtful(name: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, name.to_numpy().view(np.uint64)))

    own, doubt, held, least, count = (unused(docs, n) for n in ("__key", "__doubt", "__kept", "__id", "__n"))
    best = best.toDF(held, least, count)
    mine = docs.withColumn(own, key)
    mine = mine.withColumn(doubt, doubtful(F.xxhash64(own, "doc_id")))
    kept = mine.where(F.col(doubt)).join(best, (mine[own] == best[held]) & mine["doc_id"].eqNullSafe(best[least]))
    kept = kept.where(F.col(count) == 1).select(*mine.columns).unionByName(kept.where(F.col(count) > 1).select(*mine.columns).dropDuplicates([own]))
    return mine.where(~F.col(doubt)).select(*docs.columns).unionByName(kept.select(*docs.columns))
