"""Backtest: an ordered fold of position rules over bars, for many strategies at once.

Transforms and conditions are window expressions, computed once for each distinct signal pipeline and
condition. The fold is a scan over each series; it jumps from one entry or exit to the next, so its
Python work follows the number of trades and the bars between them are handled by numpy. Bars are
dealt out once per signal pipeline and group of strategies, not once per strategy. A long series is
folded in blocks, each from the state that ``speculation`` finds it begins in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import AT, BLOCK, HALO, Blocks, deal, has_long_series, joined
from ..functions.conditions import Condition, mask
from ..functions.series import Series, number, scan
from ..functions.transforms import apply_transforms
from .fold import Fold, Risk
from .speculation import entry_states

#: Strategies that one task folds over the same bars.
GROUP = 32
SIDES = ("long_entry", "short_entry", "long_exit", "short_exit")
TRADE = (
    "entry_ts timestamp_ntz, exit_ts timestamp_ntz, side string, entry_price double, exit_price double, entry_idx bigint, exit_idx bigint, bars_held bigint, "
    "position_size_pct double, allocated_capital double, units double, pnl_pct double, pnl_cash double, account_return_pct double, "
    "fee_cash double, slippage_cash double, entry_signal double, exit_signal double, exit_reason string"
)


@dataclass(frozen=True)
class Strategy:
    """What to simulate: a signal pipeline of ``(transform, options)``, conditions, risk rules and named parameters."""

    name: str = "strategy"
    transforms: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()
    long_entry: Condition | None = None
    short_entry: Condition | None = None
    long_exit: Condition | None = None
    short_exit: Condition | None = None
    risk: Risk = field(default_factory=Risk)
    params: tuple[tuple[str, object], ...] = ()

    @property
    def strategy_id(self) -> str:
        parts = [self.name, *(f"{k}-{'NONE' if v is None else v}" for k, v in self.params)]
        return "__".join(parts).replace(" ", "_")

    def conditions(self) -> list[Condition]:
        return [c for c in (getattr(self, side) for side in SIDES) if c is not None]

    def with_params(self, **params: object) -> Strategy:
        return replace(self, params=tuple({**dict(self.params), **params}.items()))


def prepare(bars: DataFrame, transforms: Sequence[tuple[str, Sequence[tuple[str, object]]]], series: Series) -> DataFrame:
    """Bars with ``signal_raw`` and the transformed ``signal``; rows that lack signal or prices go.

    ``open``, ``high`` and ``low`` default to ``close``, as ``benchmark`` does if there is no such column.
    """
    close = number("close")
    legs = {c: F.coalesce(number(c), close) if c in bars.columns else close for c in ("open", "high", "low")}
    legs["benchmark"] = number("benchmark") if "benchmark" in bars.columns else close
    out = bars.select(*series.keys, series.ts, number("signal").alias("signal_raw"), close.alias("close"), *(v.alias(k) for k, v in legs.items()))
    out = out.withColumn("signal", F.col("signal_raw"))
    out = apply_transforms(out, [(name, dict(options)) for name, options in transforms], "signal", series)
    return out.dropna(subset=["signal", "close", "open", "high", "low"])


def simulate(bars: DataFrame, strategies: Sequence[Strategy], series: Series = Series(), capital: float = 100.0) -> DataFrame:
    """A row for each strategy and bar: keys, ``strategy_id``, ts, ``idx``, prices, signal, ``equity``, ``position``, ``trades``.

    ``trades`` holds what closes on the bar, else null. A bar tests stop-loss, take-profit and signal
    exit in this order, then entries, long first, at its close; the last bar closes what is open.
    A series without usable bars gives no rows.
    """
    if len({s.strategy_id for s in strategies}) < len(strategies):
        raise ValueError("strategies need distinct names or parameters")
    pipelines: dict[tuple, list[Strategy]] = {}
    for s in strategies:
        pipelines.setdefault(s.transforms, []).append(s)
    groups = [own[k : k + GROUP] for own in pipelines.values() for k in range(0, len(own), GROUP)]
    long = has_long_series(bars, series)  # found once for all pipelines
    plan = _Plan(list(pipelines), groups, list(dict.fromkeys(c for s in strategies for c in s.conditions())), Series(series.keys, series.ts, long), capital)
    return plan.in_blocks(bars) if long else plan.whole(bars)


@dataclass(frozen=True)
class _Plan:
    """Strategies dealt to groups of one signal pipeline each, and the conditions that any of them uses."""

    pipelines: list[tuple]
    groups: list[list[Strategy]]
    conditions: list[Condition]
    series: Series
    capital: float

    def used(self, transforms: tuple) -> set[Condition]:
        return {c for own in self.groups for s in own if s.transforms == transforms for c in s.conditions()}

    def with_hits(self, ready: DataFrame, transforms: tuple, series: Series) -> DataFrame:
        """Adds ``hits``, an entry a condition."""
        used = self.used(transforms)
        hits = F.array(*(mask(c if c in used else None, F.col("signal"), series) for c in self.conditions)) if self.conditions else F.array().cast("array<boolean>")
        names = ready.columns
        for c in used:
            ready = c.added(ready, "signal", series)
        return ready.select(*names, hits.alias("hits"))

    def with_groups(self, ready: DataFrame, transforms: tuple, first: Column) -> DataFrame:
        """Adds ``benchmark_equity`` and a row for each group of the pipeline; ``first`` is a series' first benchmark."""
        numbers = [g for g, members in enumerate(self.groups) if members[0].transforms == transforms]
        rebased = F.col("benchmark") / F.when(first != 0, first) * self.capital
        return ready.withColumns({"benchmark_equity": rebased, "group": F.explode(F.array(*map(F.lit, numbers)))})

    def whole(self, bars: DataFrame) -> DataFrame:
        """Each series in one task."""
        parts = []
        for transforms in self.pipelines:
            ready = self.with_hits(prepare(bars, transforms, self.series), transforms, self.series)
            parts.append(self.with_groups(ready, transforms, F.first("benchmark").over(self.series.running())))
        return self.folded(reduce(DataFrame.unionByName, parts), Series((*self.series.keys, "group"), self.series.ts))

    def in_blocks(self, bars: DataFrame) -> DataFrame:
        """Long series in many tasks: bars are prepared and dealt to blocks, which are folded twice.

        The first pass tells how a block ends for every state it can begin in, a chain of one row a block then
        picks the state, and the second pass folds from it.
        """
        keys, lookback = list(self.series.keys), [c.lookback for c in self.conditions]
        early = None in lookback  # a condition that may look back without bound sees whole series
        parts = []
        for p, transforms in enumerate(self.pipelines):
            ready = prepare(bars, transforms, self.series).withColumn("pipeline", F.lit(p))
            parts.append(self.with_hits(ready, transforms, self.series) if early else ready)
        blocks = deal(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), Series((*keys, "pipeline"), self.series.ts))
        rows = blocks.with_halo(0 if early else max([0, *lookback]))
        firsts = blocks.rows.groupBy(*blocks.keys).agg(F.min_by("benchmark", AT).alias("first_benchmark"))
        dealt = []
        for p, transforms in enumerate(self.pipelines):
            own = rows.where(F.col("pipeline") == p)
            own = (own if early else self.with_hits(own, transforms, blocks.series)).where(~F.col(HALO))
            dealt.append(self.with_groups(joined(own, firsts, blocks.keys), transforms, F.col("first_benchmark")))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dealt).select(*keys, self.series.ts, "close", "high", "low", "signal", "benchmark", "benchmark_equity", "hits", "pipeline", "group", BLOCK, AT)
        rows = self._with_states(blocks, rows)
        return self.folded(rows, Series((*keys, "group", BLOCK), AT))

    def _with_states(self, blocks: Blocks, rows: DataFrame) -> DataFrame:
        """Adds, at blocks behind a border, ``offset`` bars before, ``goes_on`` unless the series ends there, and on their first rows the ``states`` of the group's strategies."""
        counts = blocks.rows.groupBy(*blocks.keys, BLOCK).agg(F.count("*").alias("n"))
        rows = blocks.carried(counts, lambda state, row: ((state[0] if state else 0) + row["n"],), ["offset"], "bigint")(rows)
        rows = blocks.marked_unless_last(rows, "goes_on")
        if not blocks.borders:
            return rows.withColumn("states", F.lit(None).cast("array<struct<s:int>>"))
        keys = [*self.series.keys, "group"]
        states = entry_states(blocks.spanning(rows), Series((*keys, BLOCK), AT), [[s.risk for s in own] for own in self.groups], self.reader(), self.capital)
        return joined(rows, states, (*keys, AT))

    def reader(self) -> Callable[[pa.Table, int], list[dict]]:
        """What turns a table of bars to arrays with the hits of each strategy of its group; it carries no condition to the tasks."""
        place, ts = {c: i for i, c in enumerate(self.conditions)}, self.series.ts
        sides = [[{side: None if (c := getattr(s, side)) is None else place[c] for side in SIDES} for s in own] for own in self.groups]

        def read(part: pa.Table, base: int) -> list[dict]:
            n = part.num_rows
            hits = part.column("hits").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            never = np.zeros(n, bool)
            bars = {c: part.column(c).to_numpy() for c in ("high", "low", "close", "signal")} | {"ts": part.column(ts), "base": base}
            return [bars | {side: never if at is None else hits[:, at].astype(bool) for side, at in own.items()} for own in sides[part.column("group")[0].as_py()]]

        return read

    def folded(self, rows: DataFrame, dealt: Series) -> DataFrame:
        """The fold of each group over ``dealt`` series, from ``states`` where there are such."""
        keys, ts = list(self.series.keys), self.series.ts
        shown = [*keys, ts, "close", "signal", "benchmark", "benchmark_equity"]
        blocked, read, capital = "states" in rows.columns, self.reader(), self.capital
        members = [[(s.strategy_id, s.risk) for s in own] for own in self.groups]

        def begun(part: pa.Table) -> tuple[int, list[Fold]]:
            offset, states = (part.column(c)[0].as_py() for c in ("offset", "states")) if blocked else (0, None)
            folds = [Fold(risk, capital) for _, risk in members[part.column("group")[0].as_py()]]
            for fold, state in zip(folds, states or ()):
                fold.resume(state)
            return offset or 0, folds

        def step(state: tuple[int, list[Fold]] | None, part: pa.Table, final: bool):
            base, folds = state or begun(part)
            final = final and not (blocked and part.column("goes_on")[0].as_py())
            n, out = part.num_rows, []
            for (name, _), fold, own in zip(members[part.column("group")[0].as_py()], folds, read(part, base)):
                equity, position, trades = fold.run(own, final)
                columns = [*(part.column(c) for c in shown), pa.array([name] * n), pa.array(np.arange(base, base + n)), pa.array(equity), pa.array(position)]
                table = pa.table(columns, names=[*shown, "strategy_id", "idx", "equity", "position"])
                out.append(table.append_column("trades", pa.array(trades, _trades_type())))
            return (base + n, folds), pa.concat_tables(out)

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in shown), "strategy_id string", "idx bigint", "equity double", "position int", f"trades array<struct<{TRADE.replace(' ', ':').replace(',:', ',')}>>"])
        return scan(rows, dealt, step, schema)


def _trades_type() -> pa.DataType:
    kinds = {"timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    return pa.list_(pa.struct([(n, kinds[k]) for n, k in (x.split(" ") for x in TRADE.split(", "))]))


def trades_of(result: DataFrame, series: Series = Series()) -> DataFrame:
    """One row for each trade of a simulation."""
    found = result.where("trades IS NOT NULL").select(*series.keys, "strategy_id", F.explode("trades").alias("trade"))
    return found.select(*series.keys, "strategy_id", "trade.*")


def trade_report(trades: DataFrame) -> DataFrame:
    """Trades with dates as text and values rounded, as reports show them."""
    places = {c: 6 for c in ("entry_price", "exit_price", "position_size_pct", "allocated_capital", "pnl_pct", "pnl_cash", "account_return_pct", "fee_cash", "slippage_cash", "entry_signal", "exit_signal")} | {"units": 10}
    out = trades.withColumns({c: F.round(c, n) for c, n in places.items()})
    dates = {f"{d}_date": F.date_format(f"{d}_ts", "yyyy-MM-dd HH:mm:ss") for d in ("entry", "exit")}
    return out.withColumns(dates).drop("entry_ts", "exit_ts", "entry_idx", "exit_idx")
