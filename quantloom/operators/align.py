"""As-of joins that never look ahead.

Rows of both sides are united and an ordered window carries the last (or next) right row to each left
row. Windows run within buckets of time, and what a bucket inherits from others comes from one summary
row a bucket, so neither an unkeyed join nor a hot key ends in one task.

A right side of few rows, which is counted first, is broadcast as sorted arrays instead: each task searches
them for its batches of left rows, which then aren't shuffled at all.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import estimated_bytes
from ..functions.series import number, seconds_between

#: Names of directions and of what happens to stale signals.
DIRECTIONS, STALE_POLICIES = ("backward", "forward", "nearest"), ("nan", "drop", "keep")
_DAY = 86_400_000_000
#: Right sides whose estimated bytes and counted rows are at most these are broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1 << 20


def micros(duration: str | float | None) -> int:
    """A duration such as ``"24h"`` or ``"730D"``, or seconds, in microseconds."""
    import pandas as pd

    if isinstance(duration, (int, float)):
        return round(duration * 1e6)
    return pd.Timedelta(duration).value // 1000


def asof(left: DataFrame, right: DataFrame, *, on: Column, right_on: Column, columns: dict[str, Column], by: Sequence[str] = (), direction: str = "backward", out: str = "match", bucket: int = _DAY, broadcast: bool | None = None) -> DataFrame:
    """``left`` with struct ``out``: ``at`` and ``columns`` of the nearest right row in ``direction``; null without one.

    ``on`` and ``right_on`` are microseconds. Equal times match. Of right rows at one time, the largest
    by ``columns`` counts backward, the smallest forward; equally near rows resolve backward. Left rows
    without time match nothing; right rows without time are ignored. ``broadcast=False`` keeps to buckets;
    otherwise a right side of at most ``BROADCAST_ROWS`` rows is broadcast.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; known: {', '.join(DIRECTIONS)}")
    if broadcast is not False and (broadcast or estimated_bytes(right) <= BROADCAST_BYTES):
        found = right.where(right_on.isNotNull()).select(*(F.col(k).alias(f"__{k}") for k in by), F.struct(right_on.alias("at"), *(c.alias(n) for n, c in columns.items())).alias("found"))
        few = found.orderBy(*(f"__{k}" for k in by), "found").limit(BROADCAST_ROWS + 1).toArrow()
        if few.num_rows <= BROADCAST_ROWS:
            return _searched(left, few, found.schema["found"].dataType.simpleString(), on, list(by), direction, out)
    return _bucketed(left, right, on, right_on, columns, by, direction, out, bucket)


def _searched(left: DataFrame, right: pa.Table, kind: str, on: Column, by: list[str], direction: str, out: str) -> DataFrame:
    """``asof`` with ``right``, of a known number of rows, in every task: keys and ``found``, in their order."""
    found = right.column("found").combine_chunks()
    found = found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)
    times = found.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*(right.column(f"__{k}").to_pylist() for k in by)) if by else [()] * len(times)):
        ends.setdefault(key, [at, at])[1] = at + 1
    shared = left.sparkSession.sparkContext.broadcast((times, found, ends))
    columns = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, found, ends = shared.value
        for batch in batches:
            t = batch.column(len(columns))
            known = np.asarray(t.is_valid())
            t, match = t.fill_null(0).to_numpy(), np.full(batch.num_rows, -1)
            for key, rows in _by_key([batch.column(columns.index(k)) for k in by], batch.num_rows):
                if key in ends:
                    a, b = ends[key]
                    match[rows] = _nearest(times[a:b], t[rows], direction, a)
            indices = pa.array(match, mask=(match < 0) | ~known)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], found.take(indices)], [*columns, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema), f"`{out}` {kind}"])
    return left.withColumn("__t", on).mapInArrow(run, schema)


def _by_key(columns: list[pa.Array], n: int) -> Iterator[tuple[tuple, np.ndarray | slice]]:
    """Values of the columns that stand together, and the rows where they do."""
    if not columns:
        yield (), slice(None)
        return
    codes, kinds = np.zeros(n, np.int64), []
    for column in columns:
        coded = column.dictionary_encode()
        kinds.append([*coded.dictionary.to_pylist(), None])
        codes = codes * len(kinds[-1]) + coded.indices.fill_null(len(kinds[-1]) - 1).to_numpy()
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if n else ():
        code, key = int(codes[rows[0]]), []
        for kind in reversed(kinds):
            code, at = divmod(code, len(kind))
            key.append(kind[at])
        yield tuple(reversed(key)), rows


def _nearest(times: np.ndarray, t: np.ndarray, direction: str, start: int) -> np.ndarray:
    """Places from ``start`` of each match in sorted ``times``; -1 without one."""
    back = np.searchsorted(times, t, "right") - 1
    ahead = np.searchsorted(times, t, "left")
    ahead = np.where(ahead < len(times), ahead, -1)
    if direction == "nearest":
        nearer = (ahead >= 0) & ((back < 0) | (times[ahead] - t < t - times[back]))
        match = np.where(nearer, ahead, back)
    else:
        match = back if direction == "backward" else ahead
    return np.where(match >= 0, match + start, -1)


def _bucketed(left: DataFrame, right: DataFrame, on: Column, right_on: Column, columns: dict[str, Column], by: Sequence[str], direction: str, out: str, bucket: int) -> DataFrame:
    by = list(by)
    found = F.struct(right_on.alias("at"), *(c.alias(n) for n, c in columns.items()))
    here = left.select(*(F.col(k).alias(f"__{k}") for k in by), on.alias("__t"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__row"))
    there = right.where(right_on.isNotNull()).select(*(F.col(k).alias(f"__{k}") for k in by), right_on.alias("__t"), found.alias("__found"))
    keys = [f"__{k}" for k in by]
    both = here.unionByName(there, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / bucket))
    group, steps = Window.partitionBy(*keys, "__b"), Window.partitionBy(*keys, F.lit(0))
    summary = both.groupBy(*keys, "__b").agg(F.max("__found").alias("__most"), F.min("__found").alias("__least"))
    is_row, summaries = F.col("__row").isNotNull(), []
    # frames grow from the first row of their order: one that reaches to the last is computed anew for every row, so ahead the order is turned
    so_far, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    if direction != "forward":
        summaries.append(F.last("__most", ignorenulls=True).over(steps.orderBy("__b").rowsBetween(*earlier)).alias("__before"))
        own = F.last("__found", ignorenulls=True).over(group.orderBy("__t", is_row, "__found").rowsBetween(*so_far))
        both = both.withColumn("__back", own)
    if direction != "backward":
        summaries.append(F.last("__least", ignorenulls=True).over(steps.orderBy(F.desc("__b")).rowsBetween(*earlier)).alias("__after"))
        own = F.last("__found", ignorenulls=True).over(group.orderBy(F.desc("__t"), is_row, F.desc("__found")).rowsBetween(*so_far))
        both = both.withColumn("__next", own)
    carried = summary.where("__b IS NOT NULL").select(*keys, "__b", *summaries)
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    joined = both.where("__row IS NOT NULL").alias("x").join(carried.alias("y"), same & (F.col("x.__b") == F.col("y.__b")), "left")
    back = F.coalesce("__back", "__before") if direction != "forward" else None
    ahead = F.coalesce("__next", "__after") if direction != "backward" else None
    if direction == "nearest":
        t = F.col("__t")
        nearer = ahead.isNotNull() & (back.isNull() | (ahead["at"] - t < t - back["at"]))
        match = F.when(nearer, ahead).otherwise(back)
    else:
        match = back if direction == "backward" else ahead
    return joined.select("__row.*", F.when(F.col("__t").isNotNull(), match).alias(out))


def time_of(column: str) -> Column:
    """A time column, or text that holds one, in microseconds; null where it can't be read."""
    return F.unix_micros(F.col(f"`{column}`").try_cast("timestamp"))


def align_signal_to_bars(bars: DataFrame, signal: DataFrame, *, execution_ts_col: str = "ts", signal_event_ts_col: str = "event_ts", signal_available_ts_col: str = "available_ts", signal_value_col: str = "signal_value", output_col: str = "signal", direction: str = "backward", tolerance: str | None = "24h", min_lag: str = "0s", stale_policy: str = "nan", by: Sequence[str] = (), broadcast: bool | None = None) -> DataFrame:
    """``bars`` with the signal known at each bar, and audit columns.

    A signal counts if it was available at the bar's time less ``min_lag``. One older than
    ``tolerance`` at the bar's own time is stale: its value is null, its row dropped, or kept, by
    ``stale_policy``. A bar without time keeps its row, with null audit columns.
    """
    if stale_policy not in STALE_POLICIES:
        raise ValueError(f"unknown stale_policy {stale_policy!r}; known: {', '.join(STALE_POLICIES)}")
    if execution_ts_col not in bars.columns:
        raise ValueError(f"bars lack {execution_ts_col!r}.")
    if signal_value_col not in signal.columns:
        raise ValueError(f"signal lacks {signal_value_col!r}.")
    event = signal_event_ts_col if signal_event_ts_col in signal.columns else "ts"
    if event not in signal.columns:
        raise ValueError(f"signal must have {signal_event_ts_col!r} or 'ts'.")
    available = signal_available_ts_col
    if available not in signal.columns:
        warnings.warn(f"signal has no {available!r}; {event!r} is taken for it, which is safe only if both are the same", RuntimeWarning, stacklevel=2)
        available = event
    value, kind = number(signal_value_col), signal.schema[available].dataType
    audit = [output_col, "signal_event_ts", "signal_available_ts", "signal_age_seconds", "is_stale_signal", "alignment_method", "lookahead_safe"]
    left = bars.drop(*audit)
    now = time_of(execution_ts_col)
    valid = signal.where(value.isNotNull())
    columns = {"event": F.col(event), "value": value, "available": F.col(available)}
    joined = asof(left, valid, on=now - micros(min_lag), right_on=time_of(available), columns=columns, by=by, direction=direction, out="__match", broadcast=broadcast)
    got = F.col("__match")
    age = (now - got["at"]) / 1e6
    stale = F.coalesce(age > micros(tolerance) / 1e6, F.lit(False)) if tolerance is not None else F.lit(False)
    safe = F.coalesce(got["at"] <= now - micros(min_lag), F.lit(False))
    shown = safe & ~stale if stale_policy == "nan" else safe
    out = joined.select(
        *left.columns,
        F.when(shown, got["value"]).alias(output_col),
        got["event"].alias("signal_event_ts"),
        got["available"].cast(kind).alias("signal_available_ts"),
        age.alias("signal_age_seconds"),
        stale.alias("is_stale_signal"),
        F.lit(f"merge_asof_{direction}_available_ts").alias("alignment_method"),
        safe.alias("lookahead_safe"),
    )
    return out.where(~F.col("is_stale_signal")) if stale_policy == "drop" else out


def merge_signal_backward(bars: DataFrame, signal: DataFrame, *, execution_ts_col: str = "ts", signal_ts_col: str = "ts", signal_value_col: str = "signal_value", output_col: str = "signal", by: Sequence[str] = (), broadcast: bool | None = None) -> DataFrame:
    """``bars`` with the last signal value by event time, however old, and its time as ``<output_col>_ts``."""
    columns = {"value": F.col(signal_value_col), "ts": F.col(signal_ts_col)}
    joined = asof(bars.drop(output_col, f"{output_col}_ts"), signal, on=time_of(execution_ts_col), right_on=time_of(signal_ts_col), columns=columns, by=by, out="__match", broadcast=broadcast)
    return joined.withColumns({output_col: F.col("__match.value"), f"{output_col}_ts": F.col("__match.ts")}).drop("__match")


def align_on_time(frames: dict[str, DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Full outer join of single-value tables: a column per name over the union of their keys."""
    out = None
    for name, frame in frames.items():
        value = next(c for c in frame.columns if c not in keys)
        own = frame.select(*keys, F.col(value).alias(name))
        out = own if out is None else out.join(own, list(keys), "full_outer")
    return out


__all__ = ["align_on_time", "align_signal_to_bars", "asof", "merge_signal_backward", "micros", "seconds_between", "time_of"]
