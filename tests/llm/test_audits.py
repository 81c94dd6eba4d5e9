"""Exact deduplication, conversation repair and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quantloom.llm import conversations
from quantloom.llm.conversations import audit, damaged, repair, repair_report
from quantloom.llm.exactdedup import STATE_STORE, absorb, dedup_report, exact_dedup, groups
from quantloom.llm.filteraudit import FILTERS, FIRST, ORDERS, filter_audit

# --- exact deduplication


def plain_dedup(rows):
    """Rows of the report, from ``(doc_id, text)`` pairs."""
    same = defaultdict(list)
    for doc_id, text in rows:
        same[text or ""].append(doc_id)
    out = Counter()
    for text, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays = i == keep and not kept
            kept |= stays
            out[i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def reported(frame):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect())


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)


def test_exact_dedup_of_odd_rows(spark, odd, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    odd.union(odd).repartition(5).write.parquet(path)
    assert reported(exact_dedup(spark, path)) == plain_dedup([(r["doc_id"], r["text"]) for r in odd.collect()] * 2)


def test_exact_dedup_of_one_file_and_of_none(spark, sf_dir, small, none, tmp_path):
    assert reported(exact_dedup(spark, f"{sf_dir}/documents.parquet")) == plain_dedup(zip(small["doc_id"].tolist(), small["text"].tolist()))
    none.write.parquet(f"{tmp_path}/none.parquet")
    assert exact_dedup(spark, f"{tmp_path}/none.parquet").count() == 0


def test_digests_that_collide_are_told_apart_by_bytes(spark, documents, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows += [(i + 10**6, t) for i, t in rows[::3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(7).write.parquet(f"{tmp_path}/in")
    absorb(streamed(spark, f"{tmp_path}/in", docs.schema), f"file://{tmp_path}/state", digest_bytes=1)
    assert groups(spark, f"file://{tmp_path}/state").count() < len({t for _, t in rows})
    assert reported(dedup_report(docs, f"file://{tmp_path}/state", digest_bytes=1)) == plain_dedup(rows)


def test_state_goes_on_with_new_files(spark, tmp_path):
    texts = [f"text {k % 40}" for k in range(100)]
    for part in range(2):
        rows = [(1000 * part + k, t) for k, t in enumerate(texts[: 100 - 60 * part])]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        docs = spark.read.parquet(f"{tmp_path}/in")
        absorb(streamed(spark, f"{tmp_path}/in", docs.schema), f"file://{tmp_path}/state")
        assert reported(dedup_report(docs, f"file://{tmp_path}/state")) == plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])


# --- conversation repair


def brute(signature):
    """The cheapest edits of all that there are, up to two inserts at a place."""
    found = []
    for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(signature) + 1):
        for edits in itertools.product("KuaD", repeat=len(signature)):
            roles, text, cost, fine = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0]), True
            for letter, edit, gap in zip(signature, edits, gaps[1:]):
                fine &= letter != "d" or edit == "D"
                roles += {"K": letter.lower(), "D": ""}.get(edit, edit) + gap
                text += ("R" if edit in "ua" else edit) + "I" * len(gap)
                cost += {"K": 0, "D": 3}.get(edit, 2) + (letter.isupper() and edit != "D") + 2 * len(gap)
            if fine and re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, text))
    return min(found)


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_audit_is_the_cheapest(length):
    rng = random.Random(length)
    signatures = {"".join(rng.choices("dsuaxSUAX", k=length)) for _ in range(40 if length < 3 else 12)}
    for signature in signatures:
        assert audit(signature) == brute(signature), signature


def plain_audit(signature):
    """Whole texts of edits compared, suffix by suffix."""
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for letter in reversed(signature):
        more, own = int(letter.isupper()), []
        for place in range(4):
            to = 3 if place == 2 else 2
            options = [(3 + best[place][0], "D" + best[place][1])]
            if letter != "d":
                options.append((2 + more + best[to][0], "R" + best[to][1]))
                kept = {"s": 1 if place == 0 else None, "u": 2 if place != 2 else None, "a": 3 if place == 2 else None}.get(letter.lower())
                if kept is not None:
                    options.append((more + best[kept][0], "K" + best[kept][1]))
            own.append(min(options))
        inserted = [(2 + own[3 if p == 2 else 2][0], "I" + own[3 if p == 2 else 2][1]) for p in range(4)]
        best = [min(own[p], inserted[p], (4 + own[2 if p == 2 else 3][0], "II" + own[2 if p == 2 else 3][1])) for p in range(4)]
    return best[0]


def plain_repair(rows):
    """Rows of the report, from damaged ``(conv_id, turn, role, text)`` rows and all ids."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        found[conv_id].append((turn is not None, turn or 0, role, text[:40], hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv_id, own in found.items():
        own.sort()
        seen, signature, faults = set(), "", Counter()
        for _, _, role, _, _, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            signature += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for known, t, *_ in own if known]
        cost, edits = plain_audit(signature)
        repaired, place, rest = [], 0, iter(own)
        for edit in edits:
            _, _, role, _, _, text = next(rest) if edit != "I" else (0, 0, "", "", "", "")
            if edit == "D":
                continue
            place = 1 if edit == "K" and role[0] == "s" else 3 if place == 2 else 2
            repaired.append(f"{role if edit == 'K' else 'user' if place == 2 else 'assistant'}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        gaps = gaps if gaps < 2**63 else 0
        out[conv_id] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def plain_damage(rows):
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        yield from [(conv_id, turn, "user" if fate == 4 else role, text)] * (fate != 0) * (1 + (fate == 3))


def repairs(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, None, "system", "Be kind."), (1, 5, None, "who?"),
    (2, None, None, None), (2, None, None, None), (3, 1, "", "nameless."), (3, 2, "bot", "x" * 5000 + "."), (3, 3, "assistant", " \t\n\x0b"),
    (None, 7, "user", "no id"), (None, 8, "assistant", "none either\n."), (4, -(2**63), "user", "first."), (4, 2**63 - 1, "assistant", "last."), (4, 3, "Ünser", "größe "),
]


@pytest.mark.parametrize("limit", [1, 4, conversations.SEGMENT])
def test_repair_of_odd_and_long_conversations(spark, monkeypatch, limit):
    monkeypatch.setattr(conversations, "SEGMENT", limit)
    rng = random.Random(3)
    rows = [*ODD, *((9, k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Fine.", "so", "", f"number {k}."])) for k in range(600))]
    rows += [(20 + c, k, rng.choice(["user", "assistant"]), f"{c} {k}.") for c in range(30) for k in range(rng.randrange(1, 7))]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS part", "1 AS seq", "text AS head")
    want = plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert repairs(repair(frame, frame)) == want
    assert repairs(repair(frame.repartition(8), frame.where("conv_id = 9"))) == want


def test_repair_report(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()] + ODD
    frame = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, damaged(frame).collect())) == Counter(plain_damage(rows))
    found = plain_repair(plain_damage(rows))
    assert repairs(repair_report(frame)) == {c: found.get(c, EMPTY) for c in {r[0] for r in rows}}
    assert repair_report(frame.where("1 = 0")).count() == 0


def test_a_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repairs(repair_report(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))) == {gone: EMPTY}


# --- filter audit


def plain_filters(docs, labels):
    """Rows of the report, every order run one filter after the other."""
    firsts = {}
    for doc_id, _, text in docs:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, source, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and doc_id > firsts[text])
        parts[source or ""].append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        shapley, found = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, own in enumerate(order, 1):
                gone, before = [r for r in left if own in r[0]], left
                left = [r for r in left if own not in r[0]]
                shapley[own] += len(gone)
                failing = sum(own in r[0] for r in rows)
                found[part, order, step] = [len(left), len(gone), failing - sum(own in r[0] for r in before), sum(r[0] == own for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        out |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in found.items()}
    return out


def audited(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in frame.collect()}


def test_filter_audit(spark, documents, odd, sf_dir, monkeypatch):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    more = [(1, 1, None), (5, None, 1), (5, 1, 0), (None, 1, 1), (6, 0, 1)]
    marks = labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame(more, labels.select("doc_id", "quality", "toxic").schema))
    own = documents.select("doc_id", "source", "text").union(odd.selectExpr("doc_id", "if(doc_id > 6, NULL, source)", "text"))
    own = own.union(documents.selectExpr("doc_id + 100000", "''", "text").limit(30)).selectExpr("*", "'mine' AS part", "1 AS mask", "'x' AS label")
    want = plain_filters([(r["doc_id"], r["source"], r["text"]) for r in own.collect()], [tuple(r) for r in marks.collect()])
    assert audited(filter_audit(own, marks)) == want
    monkeypatch.setattr("quantloom.llm.filteraudit.PARTS", 2)
    assert audited(filter_audit(own, marks)) == want
    assert filter_audit(own.where("1 = 0"), marks).count() == 0
    assert filter_audit(own, marks.where("1 = 0")).where("good_lost + toxic_lost > 0").count() == 0


def test_first_failure_table():
    for mask in range(32):
        for k, order in enumerate(ORDERS):
            assert FIRST[mask, k] == next((at for at, f in enumerate(order) if mask >> FILTERS.index(f) & 1), 5)


def test_state_files_are_committed_without_processes(spark, tmp_path):
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for k, v in STATE_STORE.items():
        conf.set(k, v)
    jvm = spark._jvm.org.apache
    manager = jvm.spark.sql.execution.streaming.checkpointing.CheckpointFileManager.create(jvm.hadoop.fs.Path(f"file://{tmp_path}"), conf)
    assert manager.getClass().getSimpleName() == "FileSystemBasedCheckpointFileManager"
