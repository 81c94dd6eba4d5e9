"""Long series in blocks that tasks work on apart.

``deal`` sorts a table by ranges of series and time and writes it once, so that a block is a run of rows of
at most one partition, wherever a series begins or ends. Two things then cross the borders of blocks:

* rows that a frame looks back to: ``Blocks.with_halo`` copies a block's last predecessors into it;
* running values: ``Blocks.carried`` folds one summary a block in order, and gives every block what holds
  before it.

Only a series that goes on over a border has such summaries or copies. There are at most as many of those
blocks as partitions, so they are folded on the driver and broadcast.

A series of at most ``LONG_ROWS`` rows is a task's work without blocks; inputs whose estimated size is at most
``SMALL_BYTES`` aren't even counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import StructType

from ..sources.shared import stored
from .series import Series

SMALL_BYTES = 256 << 20
LONG_ROWS = 1_000_000
#: Helper columns: the block, the row's place in the whole order, and whether the row is a copy.
BLOCK, AT, HALO = "__block", "__at", "__halo"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def has_long_series(df: DataFrame, series: Series) -> bool:
    """Whether a series has more than ``LONG_ROWS`` rows, unless ``series`` tells it; small inputs aren't counted."""
    if series.long is not None:
        return series.long
    if estimated_bytes(df) <= SMALL_BYTES:
        return False
    longest = df.groupBy(*series.keys).count().agg(F.max("count")).first()[0]
    return (longest or 0) > LONG_ROWS


@dataclass(frozen=True)
class Blocks:
    """``rows`` have ``BLOCK`` and ``AT``; ``borders`` are the blocks of series that have several, in order."""

    rows: DataFrame
    keys: tuple[str, ...]
    borders: tuple[Row, ...]

    @property
    def series(self) -> Series:
        """Blocks as series of their own."""
        return Series((*self.keys, BLOCK), AT)

    def _table(self, rows: list[tuple], more: str) -> DataFrame:
        """A broadcast table of ``rows``: keys, block and ``more``; at most a row a partition and column of ``more``."""
        schema = StructType([self.rows.schema[k] for k in (*self.keys, BLOCK)])
        kinds = ", ".join(f"`b_{f.name}` {f.dataType.simpleString()}" for f in schema)
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, ", ".join(x for x in (kinds, more) if x)))

    def _same(self) -> Column:
        return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in (*self.keys, BLOCK)))

    def _chains(self) -> list[list[Row]]:
        """Borders of one series each."""
        found: dict[tuple, list[Row]] = {}
        for row in self.borders:
            found.setdefault(tuple(row[k] for k in self.keys), []).append(row)
        return list(found.values())

    def with_halo(self, lookback: int, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (the blocks' own by default) and, as ``HALO`` rows of each block, the ``lookback`` rows before it."""
        rows = self.rows if rows is None else rows
        own = rows.withColumn(HALO, F.lit(False))
        copies = []
        for chain in self._chains():
            for t, target in enumerate(chain):
                need, b = lookback, t - 1
                while need > 0 and b >= 0:
                    source = chain[b]
                    taken = min(need, source["n"])
                    copies.append((*(source[k] for k in self.keys), source[BLOCK], source["first"] + source["n"] - taken, target[BLOCK]))
                    need, b = need - taken, b - 1
        if not copies:
            return own
        table = self._table(copies, "b_from bigint, b_to int")
        copied = rows.join(table, self._same() & (F.col(AT) >= F.col("b_from")))
        return own.unionByName(copied.select(*(F.col("b_to").alias(BLOCK) if c == BLOCK else c for c in rows.columns), F.lit(True).alias(HALO)))

    def own(self, rows: DataFrame) -> DataFrame:
        """``rows`` without copies and helper columns."""
        return rows.where(~F.col(HALO)).drop(BLOCK, AT, HALO)

    def spanning(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` whose series goes on over a border."""
        table = self._table([(*(r[k] for k in self.keys), r[BLOCK]) for r in self.borders], "")
        return rows.join(table, self._same(), "left_semi")

    def carried(self, summaries: DataFrame, merge: Callable[[object, Row], object], names: Sequence[str], kinds: str) -> Callable[[DataFrame], DataFrame]:
        """What adds, to rows of blocks, columns ``names`` of what holds before their block; null in a series' first.

        ``summaries`` has a row for each block of a spanning series. ``merge(state, row)`` gives the state behind
        a block; ``None`` is the state before a series. States are tuples of ``names``, of types ``kinds``.
        """
        found = {tuple(r[k] for k in (*self.keys, BLOCK)): r for r in self.spanning(summaries).collect()} if self.borders else {}
        states = []
        for chain in self._chains():
            state = None
            for border in chain:
                place = tuple(border[k] for k in (*self.keys, BLOCK))
                if state is not None:
                    states.append((*place, *state))
                if place in found:
                    state = merge(state, found[place])
        typed = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(", ")))

        def add(rows: DataFrame) -> DataFrame:
            if not states:
                return rows.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds.split(", "))})
            table = self._table(states, typed)
            return rows.join(table, self._same(), "left").drop(*(f"b_{k}" for k in (*self.keys, BLOCK)))

        return add

    def marked_unless_last(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds ``name``: whether a row's series goes on behind its block."""
        going = [(*(r[k] for k in (*self.keys, BLOCK)), True) for chain in self._chains() for r in chain[:-1]]
        if not going:
            return rows.withColumn(name, F.lit(False))
        joined = rows.join(self._table(going, f"`{name}` boolean"), self._same(), "left").drop(*(f"b_{k}" for k in (*self.keys, BLOCK)))
        return joined.withColumn(name, F.coalesce(name, F.lit(False)))

    def running(self, rows: DataFrame, name: str, value: Column, kind: str) -> DataFrame:
        """Adds ``name``, the running ``max``, ``sum``, ``product`` or ``last`` known value of a double, over whole series."""
        total, over, both, merge = RUNNING[kind]
        place = [*self.keys, BLOCK]
        rows = rows.withColumn(name, value)
        sums = rows.groupBy(*place).agg(total(F.col(name), F.col(AT)).alias("total"))
        own = over(F.col(name)).over(Window.partitionBy(*place).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))

        def following(state: tuple | None, row: Row) -> tuple | None:
            known = [v for v in (state[0] if state else None, row["total"]) if v is not None]
            return (reduce(merge, known),) if known else None

        before = f"__before_{name}"
        joined = self.carried(sums, following, [before], "double")(rows.withColumn(name, own))
        return joined.withColumn(name, both(F.col(before), F.col(name))).drop(before)


def _known(fn: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """``fn`` of two values where both are known, else the one that is."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), fn(a, b)).otherwise(F.coalesce(a, b))


#: By kind: a block's value, the window function inside it, how a value before joins it, and the same in Python.
RUNNING: dict[str, tuple] = {
    "max": (lambda v, at: F.max(v), F.max, F.greatest, max),
    "sum": (lambda v, at: F.sum(v), F.sum, _known(lambda a, b: a + b), lambda a, b: a + b),
    "product": (lambda v, at: F.product(v), F.product, _known(lambda a, b: a * b), lambda a, b: a * b),
    "last": (lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a), lambda a, b: b),
}


def joined(rows: DataFrame, own: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``own``, which has one row a value of ``keys`` at most; null keys meet."""
    same = reduce(Column.__and__, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return rows.alias("l").join(own.alias("r"), same, how).select("l.*", *(F.col(f"r.{c}") for c in own.columns if c not in keys))


def deal(df: DataFrame, series: Series) -> Blocks:
    """``df`` by ranges of series and time, written once to the shared folder.

    Rows of one series and time stay together; their order, which the table doesn't give, is then fixed.
    """
    keys = list(series.keys)
    # a number of partitions, since adaptive execution would put small ones together
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, series.ts).sortWithinPartitions(*keys, series.ts)
    rows = stored(dealt.withColumns({BLOCK: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "blocks")
    runs = rows.groupBy(*keys, BLOCK).agg(F.count("*").alias("n"), F.min(AT).alias("first"))
    several = runs.groupBy(*keys).agg(F.count("*").alias("blocks")).where("blocks > 1").drop("blocks")
    # a series with several blocks holds the first or last rows of a partition, so these are two a partition at most
    same = reduce(Column.__and__, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    borders = runs.alias("l").join(several.alias("r"), same, "left_semi").orderBy(BLOCK, "first").collect()
    return Blocks(rows, tuple(keys), tuple(borders))


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """``keys`` and ``name``, the ``q`` quantile of ``value`` in each group, interpolated; groups without a value give no row.

    Equal values are counted before they move, and what remains is dealt by ranges of group and value, so a
    group of any size is spread.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").cast("double").alias("n"))
    blocks = deal(counts, Series(tuple(keys), "v"))
    rows = blocks.running(blocks.rows, "upto", F.col("n"), "sum")
    totals = blocks.rows.groupBy(*keys).agg(((F.sum("n") - 1) * q).alias("place"))
    found = joined(rows, totals, keys).where(F.col("upto") > F.floor("place"))
    ends = [F.min(F.when(F.col("upto") > f("place"), F.col("v"))).alias(n) for n, f in (("low", F.floor), ("high", F.ceil))]
    out = found.groupBy(*keys).agg(*ends, F.max(F.col("place") - F.floor("place")).alias("part"))
    return out.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias(name))


def in_blocks(df: DataFrame, series: Series, lookback: int, fn: Callable[[DataFrame, Series], DataFrame]) -> DataFrame:
    """``fn(df, series)``, whose result at a row depends on ``lookback`` rows before it at most, block by block."""
    blocks = deal(df, series)
    return blocks.own(fn(blocks.with_halo(lookback), blocks.series))
