"""Conversation structure repair by signature deduplication.

A row of a conversation becomes one letter of its signature: its role's initial, in capitals if the text is
truncated, or ``d`` if the row has to go (blank, or a duplicate). Many conversations share a signature; each
distinct one is solved once, its audit is joined back, and edits are replayed over the texts.

Faults are told from digests, so texts are shuffled once, by the replay. Rows are dealt by ranges of
conversation and turn, so a long conversation spreads over many tasks; it is cut into segments, which a
streamed pass over a row a segment chains together. What one conversation has as one value by definition,
its audit and the digest of its joined text, is put together by one task; the digest's task streams rows and
holds one batch.

Defined cases: rows of one turn stand by role, then by the first 40 characters of their text, then by its
digest; nulls in role and text are one space; a null conv_id is a conversation of its own; a gap count beyond
the range of a long is 0, as for turns that are all null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import written
from .text import in_batches

#: Where a repaired conversation can stand: at its start, behind a system row, behind a user row, behind an answer.
START, SYSTEM, USER, ANSWER = range(4)
#: Cheapest end from each place, and its inserts.
END_COSTS, END_EDITS = (0, 4, 2, 0), ("", "II", "I", "")
#: Costs of edits.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
LEGAL = frozenset({"su", "ua", "au"})
#: Letters of a segment.
SEGMENT = 512
BLANKS = " \t\n\x0b\x0c\r"
ORDER = ["conv_id", "turn", "role", "head", "digest"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def keyed(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with what they are ordered and compared by."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    own = rows.select("conv_id", "turn", *(v.alias(k) for k, v in plain.items()))
    return own.withColumns({"head": F.substring("text", 1, 40), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))}).select(*ORDER, *more)


def marked(rows: DataFrame) -> DataFrame:
    """A row for each set of equal rows: its ``n``, whether it is ``blank``, ``first`` of its role and text, ``cut`` short, and its letters.

    The first row of a role and text is joined by its turn too, so however often a text stands in a conversation, no task sees all of it.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    own = keyed(rows, "text").select(*ORDER, (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    runs = own.groupBy(*ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    at = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))["turn"]
    firsts = own.groupBy("conv_id", "role", "digest").agg(at.alias("turn")).withColumn("first", F.lit(True)).toDF("c", "r", "d", "t", "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    out = runs.join(firsts, same, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    letter = F.when(F.col("blank") | ~F.col("first"), "d").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    letters = F.concat(letter, F.repeat(F.lit("d"), (F.col("n") - 1).cast("int")))
    return out.select(*ORDER, "n", "blank", "first", "cut", initial.alias("initial"), letters.alias("letters"))


def segments(runs: DataFrame) -> DataFrame:
    """Runs of rows in order, as ``conv_id, part, seq, signature, opening, closing, illegal, whole, runs``.

    ``opening`` and ``closing`` are the role initials at the ends, ``illegal`` counts pairs inside, and
    ``whole`` tells that the segment is known to be its conversation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = f"conv_id {kinds['conv_id']}, part bigint, seq bigint, signature string, opening string, closing string, illegal bigint, whole boolean, runs array<struct<turn:{kinds['turn']},role:string,head:string,digest:binary,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, owner, held, size, begun = TaskContext.get().partitionId(), 0, None, [], 0, False
        arrow = None
        ready: list[dict] = []

        def cut(ended: bool) -> None:
            """Makes a segment of the rows held; ``begun`` and ``ended`` tell that the conversation has no others before and behind."""
            nonlocal seq, held, size, begun
            initials = [r["initial"] for r in held]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(r["n"] - 1 for r in held)
            ready.append({"conv_id": owner, "part": part, "seq": seq, "signature": "".join(r["letters"] for r in held), "opening": initials[0], "closing": initials[-1], "illegal": illegal, "whole": begun and ended, "runs": held})
            seq, held, size, begun = seq + 1, [], 0, False

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(ready, arrow)
            ready.clear()
            return out

        for batch in batches:
            if arrow is None:
                types = {f.name: f.type for f in batch.schema}
                item = pa.struct([("turn", types["turn"]), ("role", pa.string()), ("head", pa.string()), ("digest", pa.binary()), ("n", pa.int64())])
                arrow = pa.schema([("conv_id", types["conv_id"]), ("part", pa.int64()), ("seq", pa.int64()), ("signature", pa.string()), ("opening", pa.string()), ("closing", pa.string()), ("illegal", pa.int64()), ("whole", pa.bool_()), ("runs", pa.list_(item))])
            for row in batch.to_pylist():
                if held and row["conv_id"] != owner:
                    cut(True)
                    begun = True
                elif size >= SEGMENT:
                    cut(False)
                owner = row["conv_id"]
                held.append(row)
                size += row["n"]
            if ready:
                yield flush()
        if held:
            cut(False)
            yield flush()

    dealt = runs.select(*ORDER, "n", "initial", "letters").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, schema)


def _step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """``solve`` of one letter."""
    role, more = letter.lower(), TRUNCATED * letter.isupper()
    moves: list[dict[str, tuple[int, int]]] = []  # by place: edits with their costs and the places they lead to
    for place in range(4):
        own = {"D": (DELETE + after[place], place)}
        if letter != "d":
            to = ANSWER if place == USER else USER
            own["R"] = (REROLE + more + after[to], to)
            kept = SYSTEM if role == "s" and place == START else to if role == "ua"[to == ANSWER] else None
            if kept is not None:
                own["K"] = (more + after[kept], kept)
        moves.append(own)
    best = [min(cost for cost, _ in own.values()) for own in moves]
    for _ in range(3):  # a third insert in a row never pays
        best = [min(cost, INSERT + best[ANSWER if place == USER else USER]) for place, cost in enumerate(best)]
    out = []
    for start in range(4):
        place, edits = start, ""
        while True:
            options = moves[place] | {"I": (INSERT + best[ANSWER if place == USER else USER], ANSWER if place == USER else USER)}
            edit = min(e for e, (cost, _) in options.items() if cost == best[place])
            edits, place = edits + edit, options[edit][1]
            if edit != "I":
                break
        out.append((best[start], edits, place))
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def _solve(signature: str, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    if len(signature) == 1:
        return _step(signature, after)
    middle = len(signature) // 2
    right = solve(signature[middle:], after)
    left = solve(signature[:middle], tuple(cost for cost, _, _ in right))
    return tuple((cost, edits + right[to][1], right[to][2]) for cost, edits, to in left)


def solve(signature: str, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """Cheapest edits of a signature by the place where it begins: cost, edits (ties ASCII-least) and the place where it ends.

    ``after`` has the cost of all that follows, by the place where that begins; costs include it. Edits that
    are open at one letter and place differ, so the least text is that of the least edit at every letter,
    and halves can be solved one behind the other, each with what follows it. Halves are remembered.
    """
    if not signature:
        return tuple((cost, "", place) for place, cost in enumerate(after))
    low = min(after)
    return tuple((cost + low, edits, to) for cost, edits, to in _solve(signature, tuple(cost - low for cost in after)))


def audit(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost, edits, place = solve(signature, END_COSTS)[START]
    return cost, edits + END_EDITS[place]


def solved_whole(parts: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every distinct signature of whole conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits = zip(*map(audit, batch.column(0).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])

    return parts.select("signature").distinct().mapInArrow(run, "signature string, cost bigint, audit string")


def solved_chains(parts: DataFrame) -> DataFrame:
    """``part, seq, cost, audit, illegal`` of segments that may belong to longer conversations.

    From the last segment to the first, each is solved for every place where it may begin, with what follows
    it; from the first to the last, the place where one ends picks the next one's solution. ``illegal`` is 1
    if the roles across the border before a segment are no legal pair. A task holds one batch of segments.
    """
    conv = parts.schema["conv_id"].dataType.simpleString()
    kept = f"conv_id {conv}, part bigint, seq bigint, opening string, closing string"

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, after = object(), END_COSTS
        for batch in batches:
            rows = {"costs": [], "audits": [], "places": []}
            for conv_id, signature in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                last = conv_id != owner
                owner, after = conv_id, END_COSTS if last else after
                found = solve(signature, after)
                after = tuple(cost for cost, _, _ in found)
                rows["costs"].append(list(after))
                rows["audits"].append([edits + (END_EDITS[to] if last else "") for _, edits, to in found])
                rows["places"].append([to for _, _, to in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows["costs"], pa.list_(pa.int64())), pa.array(rows["audits"], pa.list_(pa.string())), pa.array(rows["places"], pa.list_(pa.int64()))], [*batch.schema.names[:5], *rows])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, place, closing = object(), START, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = row["conv_id"] != owner
                place = START if first else place
                illegal = int(not first and closing + row["opening"] not in LEGAL)
                out.append((row["part"], row["seq"], row["costs"][START] if first else 0, row["audits"][place], illegal))
                owner, place, closing = row["conv_id"], row["places"][place], row["closing"]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], ["part", "seq", "cost", "audit", "across"])

    slim = parts.select("conv_id", "part", "seq", "opening", "closing", "signature").repartition("conv_id")
    last_first = slim.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(backwards, f"{kept}, costs array<bigint>, audits array<string>, places array<bigint>")
    return last_first.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(forwards, "part bigint, seq bigint, cost bigint, audit string, across bigint")


def edits_of(solved: DataFrame) -> DataFrame:
    """``edits`` of every run of rows that keeps a row or has inserts before it, from segments with their audits."""
    conv, item = solved.schema["conv_id"].dataType.simpleString(), solved.schema["runs"].dataType.elementType
    turn = item["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = re.findall("I*[KRD](?:I+$)?", text)
                at = 0
                for r in runs:
                    own = "".join(pieces[at : at + r["n"]])
                    at += r["n"]
                    if own.strip("D"):
                        out.append({"conv_id": conv_id, "turn": r["turn"], "role": r["role"], "head": r["head"], "digest": r["digest"], "edits": own})
            schema = pa.schema([batch.schema.field(0), batch.schema.field(2).type.value_type.field("turn"), ("role", pa.string()), ("head", pa.string()), ("digest", pa.binary()), ("edits", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return solved.select("conv_id", "audit", "runs").mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, head string, digest binary, edits string")


def replayed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: edits merged with the texts in order, and the repaired rows hashed as they stream by."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, place, state, begun, waiting = object(), START, None, False, ""

        def emit(role: str, text: str) -> None:
            nonlocal begun
            state.update((("\n" if begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            begun = True

        for batch in batches:
            done = []
            for conv_id, role, edits, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != owner or state is None:
                    if state is not None:
                        done.append((owner, state.hexdigest()))
                    owner, place, state, begun, waiting = conv_id, START, hashlib.sha256(), False, ""
                if edits is not None:
                    waiting = edits
                    continue
                for edit in waiting:
                    to = ANSWER if place == USER else USER
                    if edit == "I":
                        place = to
                        emit("user" if to == USER else "assistant", "")
                    elif edit == "R":
                        place = to
                        emit("user" if to == USER else "assistant", text)
                    elif edit == "K":
                        place = SYSTEM if role[0] == "s" else to
                        emit(role, text)
                waiting = ""
            kind = batch.schema.field(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([owner], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(keyed(rows, "text").withColumn("edits", F.lit(None).cast("string")))
    dealt = in_batches(both).repartition("conv_id").sortWithinPartitions(*ORDER, F.col("edits").desc_nulls_last())
    return dealt.select("conv_id", "role", "edits", "text").mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every id of ``conversations``, whose rows are ``rows``."""
    runs = written(marked(rows), "conversation-runs")
    turn = lambda f: f("turn").cast("decimal(20,0)")
    gaps = (turn(F.max) - turn(F.min) + 1 - F.count_distinct("turn")).try_cast("bigint")
    alive = ~F.col("blank")
    counts = runs.groupBy("conv_id").agg(
        gaps.alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(alive, F.col("n") - F.col("first").cast("bigint")).otherwise(0)).alias("duplicate"),
        F.sum((alive & F.col("first") & F.col("cut")).cast("bigint")).alias("truncated"),
    )
    parts = written(segments(runs), "conversation-segments")
    whole, others = parts.where("whole"), parts.where("NOT whole")
    known = written(solved_whole(whole), "conversation-solved")
    solved = whole.join(known, "signature").withColumn("across", F.lit(0).cast("bigint"))
    solved = solved.unionByName(others.join(written(solved_chains(others), "conversation-chains"), ["part", "seq"]))
    solved = written(solved.select("conv_id", "part", "seq", "runs", "cost", "audit", (F.col("illegal") + F.col("across")).alias("illegal")), "conversation-audits")
    audits = F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"])  # a row a segment, of what is one string
    found = solved.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(audits, "").alias("audit"))
    hashes = replayed(rows, edits_of(solved))
    united = conversations.select("conv_id").distinct()
    for frame in (counts, found, hashes):
        united = united.unionByName(frame, allowMissingColumns=True)
    defaults = {c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return united.groupBy("conv_id").agg(*(F.coalesce(F.max(c), d).alias(c) for c, d in defaults.items()))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Repairs of ``conversations`` (conv_id, turn, role, text) with planted faults."""
    return repair(damaged(conversations), conversations)
