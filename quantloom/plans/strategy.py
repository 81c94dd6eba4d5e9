"""Fluent, immutable declaration of one backtest, a sweep over parameters, and their research reports."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.conditions import Condition
from ..functions.series import Series
from ..operators.backtest import Risk, Strategy, simulate, trades_of
from ..operators.metrics import strategy_metrics
from ..sources.shared import stored


@dataclass(frozen=True)
class Backtest:
    """Bars (``symbol, ts, close, signal`` and more) and what to do with them; each method returns a new declaration."""

    bars: DataFrame
    series: Series = Series()
    capital: float = 100.0
    strategy: Strategy = field(default_factory=Strategy)

    def named(self, name: str) -> Backtest:
        return replace(self, strategy=replace(self.strategy, name=name))

    def params(self, **params: object) -> Backtest:
        return replace(self, strategy=self.strategy.with_params(**params))

    def norm(self, transform: tuple[str, dict] | str, **options: object) -> Backtest:
        """Appends a transform: ``norm("zscore", window=20)`` or ``norm(norm.zscore(window=20))``."""
        name, options = (transform, options) if isinstance(transform, str) else transform
        step = (name, tuple(sorted(options.items())))
        return replace(self, strategy=replace(self.strategy, transforms=(*self.strategy.transforms, step)))

    stand = norm

    def clear_transforms(self) -> Backtest:
        return replace(self, strategy=replace(self.strategy, transforms=()))

    def entry(self, *, long: Condition | None = None, short: Condition | None = None) -> Backtest:
        return replace(self, strategy=replace(self.strategy, long_entry=long, short_entry=short))

    def exit(self, *, long: Condition | None = None, short: Condition | None = None) -> Backtest:
        return replace(self, strategy=replace(self.strategy, long_exit=long, short_exit=short))

    def risk(self, **rules: object) -> Backtest:
        return replace(self, strategy=replace(self.strategy, risk=replace(self.strategy.risk, **rules)))

    def slice(self, start: object = None, end: object = None, inclusive_end: bool = True) -> Backtest:
        """Bars from ``start`` to ``end``; transforms then start cold."""
        return replace(self, bars=time_slice(self.bars, self.series.ts, start, end, inclusive_end))

    def run(self) -> Result:
        return run([self.strategy], self.bars, self.series, self.capital)


def time_slice(df: DataFrame, ts: str, start: object = None, end: object = None, inclusive_end: bool = True) -> DataFrame:
    t = F.col(ts)
    if start is not None:
        df = df.where(t >= F.lit(str(start)).cast(df.schema[ts].dataType))
    if end is not None:
        stop = F.lit(str(end)).cast(df.schema[ts].dataType)
        df = df.where(t <= stop if inclusive_end else t < stop)
    return df


@dataclass(frozen=True)
class Result:
    """Tables of one or many simulated strategies."""

    rows: DataFrame
    series: Series

    @property
    def keyed(self) -> Series:
        return Series((*self.series.keys, "strategy_id"), self.series.ts, self.series.long)

    @property
    def equity(self) -> DataFrame:
        return self.rows.drop("trades")

    @property
    def trades(self) -> DataFrame:
        return trades_of(self.rows, self.series)

    def stored(self) -> Result:
        """The same result, its rows written once, so that what reads them doesn't simulate anew."""
        return replace(self, rows=stored(self.rows, "backtest"))

    def metrics(self, **options: object) -> DataFrame:
        own = self.stored()
        return strategy_metrics(own.equity, own.trades, own.keyed, **options)


def run(strategies: Sequence[Strategy], bars: DataFrame, series: Series, capital: float) -> Result:
    return Result(simulate(bars, strategies, series, capital), series)


@dataclass(frozen=True)
class Sweep:
    """All combinations of a grid, each made into a strategy by ``build(base, **params)``."""

    base: Backtest
    grid: tuple[tuple[str, tuple[object, ...]], ...] = ()
    build: Callable[..., Backtest] | None = None

    def over(self, **grid: Sequence[object]) -> Sweep:
        return replace(self, grid=tuple((k, tuple(v)) for k, v in grid.items()))

    def builder(self, build: Callable[..., Backtest]) -> Sweep:
        return replace(self, build=build)

    def strategies(self) -> list[Strategy]:
        """One strategy for each combination, the last parameter fastest."""
        if self.build is None:
            raise ValueError("a sweep needs a builder")
        names = [k for k, _ in self.grid]
        out = []
        for values in itertools.product(*(v for _, v in self.grid)):
            params = dict(zip(names, values))
            out.append(self.build(self.base.params(**params), **params).strategy)
        return out

    def run(self) -> Result:
        return run(self.strategies(), self.base.bars, self.base.series, self.base.capital)

    def params(self) -> DataFrame:
        """``strategy_id`` and a typed column for each parameter."""
        rows = [(s.strategy_id, *(dict(s.params)[k] for k, _ in self.grid)) for s in self.strategies()]
        kinds = [_kind(v) for _, v in self.grid]
        spec = ", ".join(["strategy_id string", *(f"`{k}` {t}" for (k, _), t in zip(self.grid, kinds))])
        typed = [(r[0], *(float(v) if t == "double" and v is not None else v for v, t in zip(r[1:], kinds))) for r in rows]
        return self.base.bars.sparkSession.createDataFrame(typed, spec)

    def table(self, **options: object) -> DataFrame:
        """Parameters and metrics of each strategy and series."""
        return self.params().join(self.run().metrics(**options), "strategy_id")


def _kind(values: Sequence[object]) -> str:
    known = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in known):
        return "boolean"
    if all(isinstance(v, int) for v in known):
        return "bigint"
    return "double" if all(isinstance(v, (int, float)) for v in known) else "string"


def new(bars: DataFrame, *, series: Series = Series(), capital: float = 100.0) -> Backtest:
    return Backtest(bars, series, capital)


def sweep(base: Backtest, **grid: Sequence[object]) -> Sweep:
    return Sweep(base).over(**grid)


__all__ = ["Backtest", "Result", "Risk", "Strategy", "Sweep", "new", "run", "sweep", "time_slice"]
