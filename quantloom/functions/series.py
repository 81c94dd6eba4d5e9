"""Ordered series inside a table: the keys that name a series, its time column, and scans with carried state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..sources.shared import stored


@dataclass(frozen=True)
class Series:
    """Rows with equal ``keys`` form a series, ordered by ``ts``.

    ``long`` tells whether some series is too long for one task; where it is ``None``, large inputs are counted.
    """

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    long: bool | None = None

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def last_rows(self, n: int) -> WindowSpec:
        return self.ordered().rowsBetween(-(int(n) - 1), 0)


def number(value: Column | str) -> Column:
    """As double; what isn't a number, NaN included, is null. Infinities stay."""
    out = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return F.when(~F.isnan(out), out)


def finite(value: Column, default: float | None = None) -> Column:
    """As double; null, NaN and infinities become ``default``."""
    out = number(value)
    return F.when(F.abs(out) < float("inf"), out).otherwise(F.lit(default).cast("double"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, to the microsecond."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def exact_quantile(values: DataFrame, q: float, name: str = "value") -> DataFrame:
    """One row: the ``q`` quantile of the only column of ``values``, interpolated; null without any value.

    Equal values are counted before the shuffle, and what remains is dealt by ranges, so no task sorts all.
    """
    counts = values.toDF("v").where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "quantile")  # once, so that both readers agree
    below = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = dealt.groupBy("p").agg(F.sum("n").alias("n")).select("p", below.alias("below"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    rows = dealt.join(F.broadcast(starts), "p").withColumn("upto", upto)  # a row a partition
    place = (F.col("all") - 1) * F.lit(float(q))
    ends = [F.min(F.when(F.col("upto") > f(place), F.col("v"))).alias(n) for n, f in (("low", F.floor), ("high", F.ceil))]
    found = rows.agg(*ends, F.max(place - F.floor(place)).alias("part"))
    return found.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias(name))


def numbered(df: DataFrame, series: Series, name: str) -> DataFrame:
    """``df`` with the row's number in its series, from 0."""
    return df.withColumn(name, F.row_number().over(series.ordered()) - 1)


def scan(df: DataFrame, series: Series, step: Callable, schema: str) -> DataFrame:
    """Runs ``step(state, rows, final)`` over each series in order and unites the tables it returns.

    Spark deals the series out by their keys and sorts them; a task holds one Arrow batch of a series
    and the state, never the whole series. ``step`` gets ``None`` as a series' first state, a table of
    its next rows, and whether they are its last; it returns ``(state, table or None)``. The last row
    known so far is held back until the next batch tells whether the series goes on, so the final call
    has at least one row.
    """
    keys = list(series.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None

        def emit(out: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

        for batch in batches:
            for part in _split(pa.Table.from_batches([batch]), keys):
                if held is not None and _key(held, keys) != _key(part, keys):
                    _, out = step(state, held, True)
                    yield from emit(out)
                    state, held = None, None
                part = part if held is None else pa.concat_tables([held, part])
                if part.num_rows > 1:
                    state, out = step(state, part.slice(0, part.num_rows - 1), False)
                    yield from emit(out)
                held = part.slice(part.num_rows - 1)
        if held is not None:
            _, out = step(state, held, True)
            yield from emit(out)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, series.ts)
    return dealt.mapInArrow(run, schema)


def _key(rows: pa.Table, keys: list[str]) -> tuple:
    return tuple(rows.column(k)[0].as_py() for k in keys)


def _split(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys."""
    import pandas as pd

    if not rows.num_rows:
        return
    named = rows.select(keys).to_pandas()
    codes = pd.DataFrame({k: pd.factorize(named[k], use_na_sentinel=False)[0] for k in keys})
    cuts = [0, *((codes.diff().iloc[1:] != 0).any(axis=1).to_numpy().nonzero()[0] + 1).tolist(), rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield rows.slice(a, b - a)
