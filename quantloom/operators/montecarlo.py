"""Monte Carlo robustness of trade sequences.

Draws come from hashes of simulation, step and seed, so they don't depend on partitioning and any engine
can repeat them. A shuffle isn't sorted: a step's trade is its image under a permutation of the numbers
below the count of trades, a Feistel network keyed by simulation, computed for each step alone. Paths of
very many trades are cut to blocks, whose products and peaks are carried over.

A report on shuffles of many trades needs no row a step: the network is run backwards, from each trade to its
step in every simulation, and packed pairs of step and return go to the block they belong to, where one
row of sums is left of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import blocks
from ..functions.blocks import deal
from ..functions.series import Series, finite
from ..sources.shared import stored

METHODS = ("bootstrap", "shuffle")
_SIM = Series(("sim",), "step")
#: Shuffles of more trades than ``PACKED_ROWS`` are packed; tasks then take about ``TASK_STEPS`` steps of all paths.
PACKED_ROWS, TASK_STEPS = 10_000, 1 << 23


def _draw(seed: int) -> Column:
    """A number below 2^32 for each simulation and step."""
    text = F.concat_ws("-", F.col("sim").cast("string"), F.col("step").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


#: Rounds of the network and the prime below which its products are taken.
ROUNDS, PRIME = 6, 2**31 - 1


def permutation_keys(sim: Column, seed: int) -> Column:
    """Two numbers below 2^28 for each round of a simulation."""
    digests = [F.md5(F.concat_ws("-", F.lit(str(seed)), sim.cast("string"), F.lit(str(k))).cast("binary")) for k in range(ROUNDS)]
    part = lambda d, at: F.conv(F.substring(d, at, 7), 16, 10).cast("bigint")
    return F.array(*(F.struct(part(d, 1).alias("a"), part(d, 8).alias("b")) for d in digests))


def permuted(df: DataFrame, x: str, keys: str, n: int, name: str) -> DataFrame:
    """Adds ``name``, the image of ``x`` under the permutation of the numbers below ``n`` that ``keys`` (``permutation_keys``) name.

    A number is a pair below the root of ``n``; each round adds to one half a function of the other. Pairs
    reach past ``n`` by less than twice that root, so an image past it is walked on, that often at most.
    """
    width = math.isqrt(max(n - 1, 0)) + 1

    def turned(s: Column, k: Column) -> Column:
        f = ((s["r"] + k["a"]) % PRIME) * ((s["r"] + k["b"]) % PRIME) % PRIME
        return F.struct(s["r"].alias("l"), ((s["l"] + f) % width).alias("r"))

    def image(value: Column) -> Column:
        return F.aggregate(F.col(keys), F.struct(F.floor(value / width).alias("l"), (value % width).alias("r")), turned, lambda s: s["l"] * width + s["r"])

    df = df.withColumn(name, image(F.col(x)))
    if width * width == n:
        return df
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(width * width - n)), F.col(name), lambda y, _: F.when(y < n, y).otherwise(image(y)))
    return df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked))


def _unpermuted(at: np.ndarray, sim: int, seed: int, n: int) -> np.ndarray:
    """The numbers whose images ``at`` are under the permutation of ``permuted``: its rounds backwards, walked on likewise."""
    width = math.isqrt(max(n - 1, 0)) + 1
    half, added = np.arange(width), []
    for k in range(ROUNDS):
        digest = hashlib.md5(f"{seed}-{sim}-{k}".encode()).hexdigest()
        a, b = int(digest[:7], 16), int(digest[7:14], 16)
        added.append((half + a) % PRIME * ((half + b) % PRIME) % PRIME % width)

    def before(y: np.ndarray) -> np.ndarray:
        left, right = np.divmod(y, width)
        for f in reversed(added):
            left, right = right - f[left], left
            left += width * (left < 0)
        return left * width + right

    step = before(at)
    while len(far := np.flatnonzero(step >= n)):
        step[far] = before(step[far])
    return step


def _dealt(n: int, n_sims: int, seed: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``at, r`` to a row a simulation and block of ``size`` steps: the places in the block and returns of a task's trades, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [[b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)] for b in batches]  # as many rows as TASK_STEPS allows
        at, r = (np.concatenate(c) for c in zip(*taken)) if taken else ((), ())
        for sim in range(n_sims if len(at) else 0):
            block, place = np.divmod(_unpermuted(at, sim, seed, n), size)
            order = np.argsort(block, kind="stable")
            own, starts = np.unique(block[order], return_index=True)
            cuts = [*starts, len(order)]
            places, values = place[order].astype(np.uint32), r[order]
            packed = [pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for v in (places, values)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), sim)), pa.array(own), *packed], ["sim", "block", "places", "values"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """One row of a block: product, least and greatest of its running product, deepest drawdown; count, mean and squares of returns but a path's first."""
    places, values = ([np.frombuffer(b.as_buffer(), kind) for b in rows.column(c)] for c, kind in (("places", np.uint32), ("values", np.float64)))
    r = np.empty(sum(map(len, places)))
    for at, own in zip(places, values):
        r[at] = own
    with np.errstate(all="ignore"):
        grown = np.cumprod(1 + r)
        peak = np.maximum.accumulate(grown)
        depth = np.max((peak - grown) / peak)
    block = rows.column("block")[0].as_py()
    counted = r[1:] if block == 0 else r
    mean = counted.mean() if len(counted) else 0.0
    sums = {"grown": grown[-1], "low": grown.min(), "high": peak[-1], "depth": depth, "n": len(counted), "mean": mean, "squares": np.square(counted - mean).sum()}
    return pa.table({"sim": [rows.column("sim")[0].as_py()], "block": [block]} | {k: [v] for k, v in sums.items()})


def shuffled_metrics(own: DataFrame, n: int, n_sims: int, seed: int, initial_equity: float = 1.0) -> DataFrame:
    """``path_metrics`` of ``n_sims`` shuffles of ``own``: ``at`` from 0 to ``n - 1`` and ``r``, all above -1.

    Equity is then positive, so a block's deepest drawdown is its own one, at any scale, or its lowest equity below the peak before it.
    """
    tasks = n * n_sims // TASK_STEPS + 1
    packed = own.repartition(tasks, "at").mapInArrow(_dealt(n, n_sims, seed, blocks.LONG_ROWS), "sim bigint, block bigint, places binary, values binary")
    sums = packed.repartition(tasks, "sim", "block").groupBy("sim", "block").applyInArrow(_summed, "sim bigint, block bigint, grown double, low double, high double, depth double, n bigint, mean double, squares double")
    path, before = Window.partitionBy("sim"), Window.partitionBy("sim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    start = F.coalesce(F.product("grown").over(before), F.lit(1.0)) * initial_equity
    rows = sums.withColumn("start", start).withColumns({"top": F.col("start") * F.col("high"), "terminal": F.col("start") * F.col("grown")})
    rows = rows.withColumns({"peak": F.max("top").over(before), "all": F.sum("n").over(path), "average": F.sum(F.col("n") * F.col("mean")).over(path) / F.nullif(F.sum("n").over(path), F.lit(0))})
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("start") * F.col("low")) / F.when(F.col("peak") > 0, F.col("peak")))
    depth = F.when(F.col("top") < float("inf"), F.greatest("depth", fall)).otherwise(float("nan"))  # as of a row without a number
    squares = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("average"), 2))
    out = rows.groupBy("sim").agg(F.max_by("terminal", "block").alias("terminal"), F.max(depth).alias("max_drawdown"), F.max("average").alias("mean"), F.sqrt(squares / F.nullif(F.max("all"), F.lit(0))).alias("std"))
    sharpe = F.when(F.col("std") > 1e-12, F.col("mean") / F.when(F.col("std") != 0, F.col("std"))).otherwise(0.0) * F.sqrt(F.lit(365.0))
    return out.select("sim", "terminal", "max_drawdown", sharpe.alias("sharpe"))


def _known(returns: DataFrame) -> tuple[DataFrame, int, float]:
    """``at, r`` of the finite returns, numbered from 0 without the others, their count and the lowest one."""
    own = returns.select(F.col("step").cast("bigint").alias("at"), finite(F.col("r")).alias("r")).where("r IS NOT NULL")
    n, low, last = own.agg(F.count("*"), F.min("r"), F.max("at")).first()
    if n and last != n - 1:
        own = _numbered(own, ["at"]).select(F.col("step").alias("at"), "r")
    return own, n, low


def simulate_trade_paths(returns: DataFrame, *, n_sims: int = 1000, seed: int = 0, method: str = "bootstrap", initial_equity: float = 1.0) -> DataFrame:
    """``sim, step, r, equity``: paths of as many steps as there are finite ``r`` (fractions) in ``returns``.

    ``returns`` has ``step``, numbered from 0, and ``r``; ``bootstrap`` draws with replacement, ``shuffle``
    permutes. The starting equity isn't part of a path.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    own, n, _ = _known(returns)
    spark = returns.sparkSession
    steps = spark.range(n_sims * n).select(F.floor(F.col("id") / max(n, 1)).alias("sim"), (F.col("id") % max(n, 1)).alias("step"))
    if method == "bootstrap":
        steps = steps.withColumn("at", _draw(seed) % max(n, 1))
    else:
        keys = spark.range(n_sims).select(F.col("id").alias("sim"), permutation_keys(F.col("id"), seed).alias("keys"))
        steps = permuted(steps.join(F.broadcast(keys), "sim"), "step", "keys", max(n, 1), "at")  # n_sims rows
    paths = steps.join(own, "at").select("sim", "step", "r")
    if n > blocks.LONG_ROWS:
        dealt = deal(paths, _SIM)
        grown = dealt.running(dealt.rows, "equity", 1 + F.col("r"), "product")
        return grown.select("sim", "step", "r", (F.col("equity") * initial_equity).alias("equity"))
    return paths.withColumn("equity", F.product(1 + F.col("r")).over(_SIM.running()) * initial_equity)


def path_metrics(paths: DataFrame, long: bool = False) -> DataFrame:
    """``sim, terminal, max_drawdown, sharpe`` of each path, the ratio over a year of 365 steps; ``long`` paths are cut to blocks."""
    if long:
        dealt = deal(paths.select("sim", "step", "equity"), _SIM)
        before = F.lag("equity").over(dealt.series.ordered())
        rows = dealt.with_halo(1).withColumn("before", before).where("NOT __halo")
        rows = dealt.running(rows, "peak", F.col("equity"), "max")
    else:
        rows = paths.withColumns({"before": F.lag("equity").over(_SIM.ordered()), "peak": F.max("equity").over(_SIM.running())})
    peak, before = F.col("peak"), F.col("before")
    depth = F.when(peak > 0, (peak - F.col("equity")) / F.when(peak > 0, peak)).otherwise(0.0)
    rows = rows.withColumns({"dd": depth, "own": finite(F.col("equity") / F.when(before != 0, before) - 1)})
    mean, std = F.avg("own"), F.stddev_pop("own")
    sharpe = F.when(std > 1e-12, mean / F.when(std != 0, std)).otherwise(0.0) * F.sqrt(F.lit(365.0))
    return rows.groupBy("sim").agg(F.max_by("equity", "step").alias("terminal"), F.max("dd").alias("max_drawdown"), sharpe.alias("sharpe"))


def robustness(returns: DataFrame, *, n_sims: int = 1000, seed: int = 0, method: str = "bootstrap", initial_equity: float = 1.0) -> DataFrame:
    """One row: chances of a loss and of a negative Sharpe ratio, drawdowns and terminal quantiles; neutral without returns."""
    known, n, low = _known(returns)
    if method == "shuffle" and n > PACKED_ROWS and low > -1 and initial_equity > 0:
        own = shuffled_metrics(known, n, n_sims, seed, initial_equity)
    else:
        paths = simulate_trade_paths(returns, n_sims=n_sims, seed=seed, method=method, initial_equity=initial_equity)
        own = path_metrics(paths, n > blocks.LONG_ROWS)

    def share(test: Column) -> Column:
        return F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0))

    def quantile(name: str, q: float, default: float, scale: float = 1.0) -> Column:
        return F.coalesce(F.percentile(name, F.lit(q)) * scale, F.lit(float(default)))

    return own.agg(
        F.lit(int(n_sims)).alias("n_sims"),
        F.lit(method).alias("method"),
        share(F.col("terminal") < initial_equity).alias("probability_of_loss"),
        share(F.col("sharpe") < 0).alias("probability_sharpe_below_zero"),
        F.coalesce(F.avg("max_drawdown") * 100, F.lit(0.0)).alias("expected_worst_drawdown"),
        *(quantile("terminal", q, initial_equity).alias(f"terminal_equity_p{round(100 * q):02d}") for q in (0.05, 0.5, 0.95)),
        quantile("max_drawdown", 0.95, 0.0, 100.0).alias("drawdown_p95"),
    )


def trade_returns(trades: DataFrame, order: list[str]) -> DataFrame:
    """``step, r``: trades' returns on the account, as fractions, numbered in ``order`` from 0."""
    value = "account_return_pct" if "account_return_pct" in trades.columns else "pnl_pct"
    own = trades.select(*order, finite(F.col(value)).alias("pct")).where("pct IS NOT NULL")
    return _numbered(own, order).select("step", (F.col("pct") / 100).alias("r"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``step``, the rows' number in ``order`` from 0."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "returns")  # once, so that both readers agree
    place = F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1
    counts = dealt.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = counts.select("p", before.alias("before"))
    return dealt.withColumn("k", place).join(starts, "p").select(*rows.columns, (F.col("before") + F.col("k")).alias("step"))
