"""Entry and exit conditions as boolean columns over an ordered series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .series import Series, scan


class Condition:
    """A plug-in condition defines ``column``; it must be hashable, so that equal ones are computed once.

    ``lookback`` is the number of rows before its own that a hit depends on, if that is bounded; a condition
    that doesn't tell sees whole series.
    """

    lookback: int | None = None

    def column(self, signal: Column, series: Series) -> Column:
        raise NotImplementedError

    def added(self, df: DataFrame, signal: str, series: Series) -> DataFrame:
        """``df`` with whatever columns ``column`` needs besides the signal."""
        return df


@dataclass(frozen=True)
class Custom(Condition):
    """A condition in Python: ``fn(values)`` tells for each value whether it is a hit, as an array.

    ``values`` are a piece of a series in order, behind the ``lookback`` values before it (fewer at the
    series' start), so a task never holds a whole series; hits of the values before are ignored.
    """

    fn: Callable[[np.ndarray], np.ndarray]
    lookback: int = 1

    @classmethod
    def each(cls, fn: Callable[[np.ndarray, int], bool], lookback: int = 1) -> Custom:
        """From a function of the values and a position among them; it may look back ``lookback`` values."""
        return cls(_Each(fn), lookback)

    @property
    def _name(self) -> str:
        return f"__custom_{hash(self) & 0xFFFFFFFFFFFF:x}"

    def column(self, signal: Column, series: Series) -> Column:
        return F.col(self._name)

    def added(self, df: DataFrame, signal: str, series: Series) -> DataFrame:
        out = df.withColumn(self._name, F.lit(None).cast("boolean"))
        at, fn, lookback = df.columns.index(signal), self.fn, self.lookback

        def step(before: np.ndarray | None, rows: pa.Table, final: bool):
            own = rows.column(at).to_numpy()
            values = own if before is None else np.concatenate((before, own))
            hits = np.asarray(fn(values), bool)[len(values) - len(own) :]
            last = rows.num_columns - 1
            return values[len(values) - lookback :] if lookback < len(values) else values, rows.set_column(last, rows.field(last), pa.array(hits))

        return scan(out, series, step, out.schema)


@dataclass(frozen=True)
class _Each:
    """A function of single positions, as one of all."""

    fn: Callable[[np.ndarray, int], bool]

    def __call__(self, values: np.ndarray) -> list[bool]:
        return [bool(self.fn(values, k)) for k in range(len(values))]


def _hit(signal: Column, level: float, inclusive: bool, up: bool) -> Column:
    if up:
        return signal >= level if inclusive else signal > level
    return signal <= level if inclusive else signal < level


@dataclass(frozen=True)
class Above(Condition):
    lookback = 0
    level: float
    inclusive: bool = True

    def column(self, signal: Column, series: Series) -> Column:
        return _hit(signal, self.level, self.inclusive, True)


@dataclass(frozen=True)
class Below(Condition):
    lookback = 0
    level: float
    inclusive: bool = True

    def column(self, signal: Column, series: Series) -> Column:
        return _hit(signal, self.level, self.inclusive, False)


def _crossed(signal: Column, series: Series, level: float, inclusive: bool, first: bool, up: bool) -> Column:
    """The row before is strictly on the other side; a series' first row counts by its own value if ``first``."""
    hit, order = _hit(signal, level, inclusive, up), series.ordered()
    before = F.lag(signal).over(order)
    crossed = hit & (before < level if up else before > level)
    return F.when(F.row_number().over(order) == 1, hit & F.lit(first)).otherwise(crossed)


@dataclass(frozen=True)
class CrossAbove(Condition):
    lookback = 1
    level: float
    inclusive: bool = True
    trigger_on_first_bar: bool = True

    def column(self, signal: Column, series: Series) -> Column:
        return _crossed(signal, series, self.level, self.inclusive, self.trigger_on_first_bar, True)


@dataclass(frozen=True)
class CrossBelow(Condition):
    lookback = 1
    level: float
    inclusive: bool = True
    trigger_on_first_bar: bool = True

    def column(self, signal: Column, series: Series) -> Column:
        return _crossed(signal, series, self.level, self.inclusive, self.trigger_on_first_bar, False)


CONDITIONS: dict[str, Callable[..., Condition]] = {"above": Above, "below": Below, "cross_above": CrossAbove, "cross_below": CrossBelow, "custom": Custom, "each": Custom.each}


def register_condition(name: str, factory: Callable[..., Condition]) -> None:
    """Adds a condition factory, reachable as ``cond.<name>``."""
    CONDITIONS[name] = factory


class _Namespace:
    def __getattr__(self, name: str) -> Callable[..., Condition]:
        if name not in CONDITIONS:
            raise AttributeError(name)
        return CONDITIONS[name]


cond = _Namespace()


def mask(condition: Condition | None, signal: Column, series: Series) -> Column:
    """The condition's column; false where there is no condition or no answer."""
    return F.lit(False) if condition is None else F.coalesce(condition.column(signal, series), F.lit(False))
