"""Signal transforms over ordered series.

A transform is ``fn(df, column, series, **options) -> DataFrame`` that replaces ``column``. Rolling
transforms need ``min_periods`` non-null values in their frame (the window size unless said
otherwise); fewer give null.

A long series isn't one task's work: transforms that look back a bounded number of rows run over blocks with
copies of the rows before them, the others carry over what they need (see ``functions.blocks``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import AT, BLOCK, deal, has_long_series, in_blocks, joined
from .series import Series, finite, number, scan

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, Transform] = {}
#: By transform: how many rows before its own a result depends on, given the options.
LOOKBACKS: dict[str, Callable[..., int]] = {}
#: By transform that looks back without bound: the same for long series.
LONG: dict[str, Transform] = {}


def register_transform(name: str, lookback: Callable[..., int] | None = None, long: Transform | None = None) -> Callable[[Transform], Transform]:
    """Decorator that adds a transform under ``name``; one with neither ``lookback`` nor ``long`` has each series in one task."""

    def add(fn: Transform) -> Transform:
        TRANSFORMS[name] = fn
        for table, value in ((LOOKBACKS, lookback), (LONG, long)):
            table.pop(name, None)
            if value is not None:
                table[name] = value
        return fn

    return add


def apply_transform(df: DataFrame, name: str, column: str, series: Series, **options) -> DataFrame:
    return apply_transforms(df, [(name, options)], column, series)


def apply_transforms(df: DataFrame, steps: Sequence[tuple[str, dict]], column: str, series: Series) -> DataFrame:
    """Transforms one behind the other; those that look back a bounded number of rows share their blocks."""
    for name, _ in steps:
        if name not in TRANSFORMS:
            raise KeyError(f"unknown transform {name!r}; known: {sorted(TRANSFORMS)}")
    long = any(name in LOOKBACKS or name in LONG for name, _ in steps) and has_long_series(df, series)
    at = 0
    while at < len(steps):
        end = at
        while long and end < len(steps) and steps[end][0] in LOOKBACKS:
            end += 1
        if end > at:
            run = steps[at:end]
            chain = lambda rows, own, run=run: reduce(lambda out, step: TRANSFORMS[step[0]](out, column, own, **step[1]), run, rows)
            df = in_blocks(df, series, sum(LOOKBACKS[name](**options) for name, options in run), chain)
        else:
            name, options = steps[at]
            df = (LONG[name] if long and name in LONG else TRANSFORMS[name])(df, column, series, **options)
            end = at + 1
        at = end
    return df


def _nonzero(value: Column) -> Column:
    return F.when(value != 0, value)


def _enough(x: Column, series: Series, window: int, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(series.last_rows(window)) >= least, value)


@register_transform("identity", lookback=lambda: 0)
def identity(df: DataFrame, column: str, series: Series) -> DataFrame:
    return df.withColumn(column, number(column))


@register_transform("zscore", lookback=lambda window=20, **_: window - 1)
def zscore(df: DataFrame, column: str, series: Series, window: int = 20, min_periods: int | None = None, ddof: int = 0) -> DataFrame:
    """(x - mean) / deviation over the last ``window`` rows; a deviation of zero gives null."""
    x, rows = number(column), series.last_rows(window)
    if ddof == 0:
        std = F.stddev_pop(x).over(rows)
    else:
        n = F.count(x).over(rows)
        std = F.sqrt(F.when(n > ddof, F.var_pop(x).over(rows) * n / (n - ddof)))
    value = (x - F.avg(x).over(rows)) / _nonzero(std)
    return df.withColumn(column, _enough(x, series, window, min_periods or window, value))


def _minmax_long(df: DataFrame, column: str, series: Series, window: int | None = None) -> DataFrame:
    if window is not None:
        return in_blocks(df, series, window - 1, lambda rows, own: minmax(rows, column, own, window))
    x, keys = number(column), list(series.keys)
    ends = df.groupBy(*keys).agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    rows = joined(df, ends, keys)
    return rows.withColumn(column, (x - F.col("__low")) / _nonzero(F.col("__high") - F.col("__low"))).drop("__low", "__high")


@register_transform("minmax", long=_minmax_long)
def minmax(df: DataFrame, column: str, series: Series, window: int | None = None) -> DataFrame:
    """(x - min) / (max - min) over the last ``window`` rows; without a window over the whole series, later rows included."""
    x = number(column)
    rows = series.whole() if window is None else series.last_rows(window)
    low, high = F.min(x).over(rows), F.max(x).over(rows)
    value = (x - low) / _nonzero(high - low)
    return df.withColumn(column, value if window is None else _enough(x, series, window, window, value))


@register_transform("robust_zscore", lookback=lambda window=20: 2 * (window - 1))
def robust_zscore(df: DataFrame, column: str, series: Series, window: int = 20) -> DataFrame:
    """0.6745 (x - median) / MAD, the MAD over each row's distance from its own median; infinite values are gaps.

    A scan keeps the values before, and medians slide over an ordered window that gains and loses a value a
    row (pandas' rolling skip list), so a row's cost grows with the logarithm of the window, not with the window.
    """
    df = df.withColumn(column, finite(F.col(column)))
    at, kept = df.columns.index(column), 2 * (window - 1)

    def step(before: np.ndarray | None, rows: pa.Table, final: bool):
        own = rows.column(at).to_numpy()
        x = pd.Series(own if before is None else np.concatenate([before, own]), dtype=float)
        off = x - x.rolling(window).median()
        score = 0.6745 * off / off.abs().rolling(window).median().replace(0.0, np.nan)
        out = pa.array(score.to_numpy()[len(x) - len(own) :], from_pandas=True)
        return x.to_numpy()[max(len(x) - kept, 0) :], rows.set_column(at, rows.field(at), out)

    return scan(df, series, step, df.schema)


def _change(df: DataFrame, column: str, series: Series, periods: int) -> DataFrame:
    now, then = F.col("__filled"), F.lag("__filled", periods).over(series.ordered())
    from_zero = F.when(now > 0, F.lit(math.inf)).when(now < 0, F.lit(-math.inf))
    return df.withColumn(column, F.when(then == 0, from_zero).otherwise(now / _nonzero(then) - 1)).drop("__filled")


def _pct_change_long(df: DataFrame, column: str, series: Series, periods: int = 1) -> DataFrame:
    blocks = deal(df, series)
    filled = blocks.running(blocks.rows, "__filled", number(column), "last")
    return blocks.own(_change(blocks.with_halo(periods, filled), column, blocks.series, periods))


@register_transform("pct_change", long=_pct_change_long)
def pct_change(df: DataFrame, column: str, series: Series, periods: int = 1) -> DataFrame:
    """x / x[-periods] - 1, gaps filled forward first; from zero it is an infinity of the sign of x, or null."""
    df = df.withColumn("__filled", F.last(number(column), ignorenulls=True).over(series.running()))
    return _change(df, column, series, periods)


@register_transform("sma", lookback=lambda window=20: window - 1)
def sma(df: DataFrame, column: str, series: Series, window: int = 20) -> DataFrame:
    x = number(column)
    return df.withColumn(column, _enough(x, series, window, window, F.avg(x).over(series.last_rows(window))))


def _ema_long(df: DataFrame, column: str, series: Series, span: int = 20, adjust: bool = False) -> DataFrame:
    """Blocks are affine maps of the average before them: composed within each, then applied in order, a row a block."""
    blocks = deal(df.withColumn(column, number(column)), series)
    if not blocks.borders:
        return TRANSFORMS["ema"](df, column, series, span=span, adjust=adjust)
    decay, keys = 1 - 2 / (span + 1), [*blocks.keys, BLOCK]
    at = blocks.rows.columns.index(column)

    def step(state: tuple | None, rows: pa.Table, final: bool):
        state = _composed(state, rows.column(at).to_numpy(), span, adjust)
        names = [*keys, *_EMA_MAP]
        return state, pa.table([*(rows.column(k).slice(0, 1) for k in keys), *([v] for v in state)], schema=pa.schema([*(rows.schema.field(k) for k in keys), *((n, pa.float64()) for n in names[len(keys) :])])) if final else None

    kinds = ", ".join(f"`{k}` {blocks.rows.schema[k].dataType.simpleString()}" for k in keys)
    maps = scan(blocks.spanning(blocks.rows), blocks.series, step, f"{kinds}, {', '.join(f'{n} double' for n in _EMA_MAP)}")
    fresh, gaps = 1.0 if adjust else 1 - decay, set()

    def merge(state: tuple[float | None, float] | None, row) -> tuple[float | None, float]:
        value, weight = state or (None, 1.0)
        lead, first, slope, shift, after, reach, tail = (row[n] for n in _EMA_MAP)
        if value is not None and lead:
            gaps.add(row[BLOCK])
        if first is None:
            return value, weight * decay**lead if value is not None else weight
        if value is None:
            start, weight = first, 1.0
        else:
            weight *= decay ** (lead + 1)
            start = (weight * value + fresh * first) / (weight + fresh)
            weight = weight + fresh if adjust else 1.0
        if adjust:  # sums of weighted values and of weights, at the last known value
            total = weight * decay**reach + after
            return (weight * decay**reach * start + shift) / total, total * decay**tail
        return slope * start + shift, decay**tail

    rows = blocks.carried(maps, merge, ["__value", "__weight"], "double, double")(blocks.rows.withColumn("__known", F.col(column).isNotNull()))
    out = _ema_scan(rows, column, blocks.series, span, adjust, carried=True)
    if gaps:  # a gap over a border repeats the very value before it, which a map gives to its last digits but one
        out = blocks.running(out, column, F.when(F.col("__known"), F.col(column)), "last")
    return out.select(*df.columns)


#: A block as a map from the average at its first known value to that at its last, ``slope * average + shift``: rows before the
#: first value, that value, the map, and rows behind the last value. If adjusted, ``shift`` and ``after`` are the sums of
#: weighted values and of weights of the rows behind the first value, and weights before decay over ``reach`` rows.
_EMA_MAP = ("lead", "first_value", "slope", "shift", "after", "reach", "tail")


def _composed(state: tuple | None, own: np.ndarray, span: int, adjust: bool) -> tuple:
    """The map of the rows in ``state`` and then ``own``."""
    decay = 1 - 2 / (span + 1)
    lead, first, slope, shift, after, reach, tail = state or (0.0, None, 1.0, 0.0, 0.0, 0.0, 0.0)
    known = ~np.isnan(own)
    if first is None:
        if not known.any():
            return lead + len(own), None, slope, shift, after, reach, tail
        at = int(known.argmax())
        lead, first, own, known = lead + at, float(own[at]), own[at + 1 :], known[at + 1 :]
    if not known.any():
        return lead, first, slope, shift, after, reach, tail + len(own)
    at, last = int(known.argmax()), len(own) - int(known[::-1].argmax())
    if adjust:
        sums, weights = (_decayed(pd.Series(np.concatenate(([v * decay**tail], x[:last]))), decay) for v, x in ((shift, np.where(known, own, 0.0)), (after, known.astype(float))))
        return lead, first, slope, float(sums[-1]), float(weights[-1]), reach + tail + last, float(len(own) - last)
    ends, alpha, weight = [], 1 - decay, decay ** (tail + at + 1)
    for start in (0.0, 1.0):  # of the values from zero: the shift; of zeros from one: the slope
        rest = pd.Series(np.where(known, 0.0 if start else own, np.nan))
        rest.iloc[at] = (weight * start + alpha * rest.iloc[at]) / (weight + alpha)
        ends.append(float(rest.iloc[at:].ewm(span=span, adjust=False).mean().iloc[-1]))
    return lead, first, slope * ends[1], shift * ends[1] + ends[0], after, reach, float(len(own) - last)


@register_transform("ema", long=_ema_long)
def ema(df: DataFrame, column: str, series: Series, span: int = 20, adjust: bool = False) -> DataFrame:
    """Exponential average with alpha 2 / (span + 1); weights go on decaying over gaps, which repeat the last value."""
    return _ema_scan(df.withColumn(column, number(column)), column, series, span, adjust)


def _ema_scan(df: DataFrame, column: str, series: Series, span: int, adjust: bool, carried: bool = False) -> DataFrame:
    """A scan carries the last value and its weight over to the next rows; ``carried`` tells that a series' first row has them.

    They stand for all rows before as one row of value ``value`` whose weight is ``weight``; within the rows
    the average is pandas' own.
    """
    decay, fresh = 1 - 2 / (span + 1), 1.0 if adjust else 2 / (span + 1)
    at = df.columns.index(column)

    def step(state: tuple[float | None, float] | None, rows: pa.Table, final: bool):
        if state is None and carried:
            value, weight = (rows.column(c)[0].as_py() for c in ("__value", "__weight"))
            state = None if value is None else (value, weight)
        value, weight = state or (None, 1.0)
        own = pd.Series(rows.column(at).to_numpy())
        known = own.notna().to_numpy()
        if not known.any():
            out = np.full(len(own), np.nan if value is None else value)
            return (value, weight if value is None else weight * decay ** len(own)), rows.set_column(at, rows.field(at), pa.array(out, from_pandas=True))
        first = int(known.argmax())
        if value is None:
            start, weight = own.iloc[first], 1.0
        else:
            weight *= decay ** (first + 1)
            start = (weight * value + fresh * own.iloc[first]) / (weight + fresh)
            weight = weight + fresh if adjust else 1.0
        rest = own.iloc[first:].copy()
        rest.iloc[0] = start
        out = np.full(len(own), np.nan if value is None else value)
        if adjust:
            # sums of weighted values and of weights are both averages of the recursive kind, up to their factor
            here = known[first:].astype(float)
            here[0] = weight
            top = pd.Series(np.where(known[first:], rest.fillna(0).to_numpy() * here, 0.0))
            sums, weights = (_decayed(s, decay) for s in (top, pd.Series(here)))
            values = pd.Series(np.divide(sums, weights, where=weights > 0, out=np.zeros(len(sums)))).where(known[first:]).ffill().to_numpy()
            last = weights[-1]
        else:
            values = rest.ewm(span=span, adjust=False).mean().to_numpy()
            last = decay ** int(known[::-1].argmax())
        out[first:] = values
        return (float(out[-1]), float(last)), rows.set_column(at, rows.field(at), pa.array(out, from_pandas=True))

    return scan(df, series, step, df.schema)


def _decayed(values: pd.Series, decay: float) -> np.ndarray:
    """``s[k] = decay * s[k - 1] + values[k]``."""
    scaled = values * 1.0
    if decay == 0 or len(scaled) == 1:
        return scaled.to_numpy()
    # the recursive average of alpha = 1 - decay, whose first value isn't scaled by alpha
    scaled.iloc[1:] /= 1 - decay
    return scaled.ewm(alpha=1 - decay, adjust=False).mean().to_numpy()


class _Namespace:
    """``norm.zscore(window=5)`` is ``("zscore", {"window": 5})``, for any registered name."""

    def __getattr__(self, name: str) -> Callable[..., tuple[str, dict]]:
        if name not in TRANSFORMS:
            raise AttributeError(name)
        return lambda **options: (name, options)


norm = stand = _Namespace()
