"""States in which the blocks of a long series begin, found without folding one block behind the other.

A block can begin flat, or in a position whose price isn't known. From flat its course is one path of trades.
A position that is open at its start ends at a bar that depends on its price only through stop-loss and
take-profit levels: the first bar that is a new low or high beyond the level, or the first signal exit, if that
is earlier. So the bars at which it can end are the block's records before that signal, and behind each of
these the course is a path again; paths that meet go on as one. Cash only scales what a path earns.

Each block gives these paths as one row a strategy. A scan of one row a block then walks from state to state.
A task holds one block of one series; its row has at most as many records as the block has bars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import AT, BLOCK
from ..functions.series import Series, scan
from .fold import STATE, Fold, Risk

#: A block's summary: its first place, the path from flat, by side the records and the first signal exit, and the paths behind exits.
SUMMARY = (
    "first_at bigint, flat_growth double, flat_entry bigint, "
    + "".join(f"{side}_{kind}_bars array<bigint>, {side}_{kind}_values array<double>, " for side in ("long", "short") for kind in ("stop", "take"))
    + "long_signal bigint, long_close double, short_signal bigint, short_close double, "
    "exits array<bigint>, exit_growth array<double>, exit_entry array<bigint>, "
    "entries array<bigint>, entry_side array<int>, entry_price array<double>, entry_signal array<double>, entry_ts array<timestamp_ntz>"
)
STATE_TYPES = "cash:double,side:int,price:double,units:double,allocated:double,signal:double,at:bigint,ts:timestamp_ntz"


def _records(values: np.ndarray) -> np.ndarray:
    """Places of new minima."""
    lowest = np.minimum.accumulate(values)
    return np.flatnonzero(np.concatenate(([True], lowest[1:] < lowest[:-1]))) if len(values) else np.zeros(0, int)


def summary(b: dict, risk: Risk) -> dict:
    """How a block of bars ends for every state that it can begin in."""
    n, hit = len(b["close"]), b["long_entry"] | b["short_entry"]
    entries = np.flatnonzero(hit)
    ends: dict[int, tuple[float, int]] = {-1: (1.0, -1)}

    def entry_from(bar: int) -> int:
        at = np.searchsorted(entries, bar)
        return int(entries[at]) if at < len(entries) else -1

    def entry_behind(bar: int) -> int:
        """The first entry behind an exit."""
        return bar if risk.allow_same_bar_reentry and hit[bar] else entry_from(bar + 1)

    def path(entry: int) -> tuple[float, int]:
        """What one of cash before ``entry`` is before the last entry, and that entry if its position stays open."""
        walked = []
        while entry not in ends:
            fold = Fold(risk, 1.0)
            fold.open(b, entry)
            at = fold.exit_bar(b, entry + 1, n)
            if at is None:
                ends[entry] = (1.0, entry)
                break
            fold.close(b, at, False)
            walked.append((entry, fold.cash))
            entry = entry_behind(at)
        growth, last = ends[entry]
        for place, own in reversed(walked):
            growth *= own
            ends[place] = (growth, last)
        return growth, last

    out: dict = {}
    out["flat_growth"], out["flat_entry"] = path(entry_from(0))
    exits: set[int] = set()
    for side, sign, bad, good in (("long", 1, "low", "high"), ("short", -1, "high", "low")):
        signals = np.flatnonzero(b[f"{side}_exit"])
        signal = int(signals[0]) if len(signals) else -1
        reach = signal + 1 if signal >= 0 else n
        for kind, values, limit in (("stop", sign * b[bad], risk.stop_loss_pct), ("take", -sign * b[good], risk.take_profit_pct)):
            bars = _records(values[:reach]) if limit is not None else np.zeros(0, int)
            out[f"{side}_{kind}_bars"], out[f"{side}_{kind}_values"] = bars.tolist(), values[bars].tolist()
            exits.update(out[f"{side}_{kind}_bars"])
        out[f"{side}_signal"], out[f"{side}_close"] = signal, float(b["close"][signal]) if signal >= 0 else 0.0
        exits.update([signal] if signal >= 0 else [])
    out["exits"] = sorted(exits)
    behind = [path(entry_behind(k)) for k in out["exits"]]
    out["exit_growth"], out["exit_entry"] = [g for g, _ in behind], [e for _, e in behind]
    last = sorted({e for e in (out["flat_entry"], *out["exit_entry"]) if e >= 0})
    out["entries"] = [b["base"] + e for e in last]
    out["entry_side"] = [1 if b["long_entry"][e] else -1 for e in last]
    out["entry_price"], out["entry_signal"] = ([float(b[c][e]) for e in last] for c in ("close", "signal"))
    out["entry_ts"] = [b["ts"][e].as_py() for e in last]
    for name in ("flat_entry", "exit_entry"):
        own = out[name]
        out[name] = [b["base"] + e if e >= 0 else -1 for e in own] if isinstance(own, list) else b["base"] + own if own >= 0 else -1
    return out


def advance(fold: Fold, row: dict) -> None:
    """Takes ``fold`` from the start of a summarised block to its end."""
    growth, entry = row["flat_growth"], row["flat_entry"]
    if fold.side:
        side, levels = "long" if fold.side > 0 else "short", fold.levels()
        found = {}
        for kind, sign, level in zip(("stop", "take"), (fold.side, -fold.side), levels):
            values = row[f"{side}_{kind}_values"]
            at = np.searchsorted(-np.array(values), -sign * level) if level is not None else len(values)
            found[kind] = row[f"{side}_{kind}_bars"][at] if at < len(values) else None
        ends = [k for k in (found["stop"], found["take"], row[f"{side}_signal"]) if k is not None and k >= 0]
        if not ends:
            return
        bar = min(ends)
        price = levels[0] if found["stop"] == bar else levels[1] if found["take"] == bar else row[f"{side}_close"]
        fold.settle(price)
        at = row["exits"].index(bar) if len(row["exits"]) < 16 else int(np.searchsorted(row["exits"], bar))
        growth, entry = row["exit_growth"][at], row["exit_entry"][at]
    fold.cash *= growth
    if entry >= 0:
        at = row["entries"].index(entry)
        fold.enter(row["entry_side"][at], row["entry_price"][at], row["entry_signal"][at], entry, row["entry_ts"][at])


def entry_states(rows: DataFrame, blocks: Series, risks: Sequence[Sequence[Risk]], block_of: Callable[[pa.Table, int], list[dict]], capital: float) -> DataFrame:
    """``states`` of each group's strategies in order, at the first place of each of the ``blocks`` that ``rows`` are made of.

    ``block_of`` gives a block's arrays for each strategy of its group.
    """
    keys = [k for k in blocks.keys if k != BLOCK]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def gather(state: list[pa.Table] | None, part: pa.Table, final: bool):
        parts = [*(state or []), part]
        if not final:
            return parts, None
        whole = pa.concat_tables(parts).combine_chunks()
        group, base = whole.column("group")[0].as_py(), whole.column("offset")[0].as_py() or 0
        place = {k: whole.column(k)[0].as_py() for k in blocks.keys} | {"first_at": whole.column(AT)[0].as_py()}
        found = [place | {"s": s} | summary(own, risk) for s, (own, risk) in enumerate(zip(block_of(whole, base), risks[group]))]
        fields = [part.schema.field(k) for k in blocks.keys] + [pa.field("s", pa.int32())]
        return None, pa.Table.from_pylist(found, pa.schema([*fields, *_arrow(SUMMARY)]))

    def chain(fold: Fold | None, part: pa.Table, final: bool):
        out = []
        for row in part.to_pylist():
            fold = fold or Fold(risks[row["group"]][row["s"]], capital)
            out.append({k: row[k] for k in keys} | {AT: row["first_at"], "s": row["s"]} | {n: getattr(fold, n) for n in STATE})
            advance(fold, row)
        fields = [part.schema.field(k) for k in keys] + [pa.field(AT, pa.int64()), pa.field("s", pa.int32())]
        return fold, pa.Table.from_pylist(out, pa.schema([*fields, *_arrow(STATE_TYPES.replace(":", " ").replace(",", ", "))]))

    place = ", ".join(f"`{k}` {kinds[k]}" for k in blocks.keys)
    summaries = scan(rows, blocks, gather, f"{place}, s int, {SUMMARY}")
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    walked = scan(summaries, Series((*keys, "s"), BLOCK), chain, f"{own}, {AT} bigint, s int, {STATE_TYPES.replace(':', ' ')}")
    return walked.groupBy(*keys, AT).agg(F.sort_array(F.collect_list(F.struct("s", *STATE))).alias("states"))  # a group's strategies


def _arrow(columns: str) -> list[pa.Field]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
    out = []
    for name, kind in (c.split(" ") for c in columns.split(", ")):
        item = kind.removeprefix("array<").removesuffix(">")
        out.append(pa.field(name, pa.list_(kinds[item]) if item != kind else kinds[kind]))
    return out
