"""Portfolio backtest over many symbols with full rebalancing at every bar.

Prices and targets stay long, ``(ts, symbol)``, filled forward over a dense grid: a row for each time and
symbol is the result. With ``keys`` each portfolio is apart. Without fees equity is a running product of
sums over symbols (``closed_form_equity``).

With fees what is traded at a bar depends on the growth of equity up to it. With ``a`` a symbol's weight now,
``b`` its last weight times its price's growth, and ``g`` the growth of equity, that is the sum over symbols of
``|a g - b|`` times the equity before: piecewise linear in ``g``, with breaks at ``b / a``. Gains alone give ``g``
but for the last bar's fee, which is small; so nearly all breaks lie outside the range that ``g`` can have, and
each bar comes down to a slope, a constant and the few breaks inside. A scan of one such row a bar finds the
equity. Ranges are proven bounds; where equity can come near zero they are infinite, and all breaks are kept.
Positions, profits and fees follow by joins and windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import deal, has_long_series, joined
from ..functions.series import Series, finite, scan
from ..sources.shared import stored
from .metrics import EPS, period_metrics

_SCHEMA = "pre_equity double, equity double, cash double, gross_exposure double, net_exposure double, leverage double, turnover double, rebalance_count bigint, drift_from_target double"
#: Parts to which the times of a portfolio are dealt to meet its symbols.
SPREAD = 64


def net_targets(signals: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ts, symbol, target``: strategies' target weights times strategy weights, summed.

    A strategy without weight counts zero; without a weights table each counts one.
    """
    wanted = "target_weight" if "target_weight" in signals.columns else "signal_value"
    if wanted not in signals.columns:
        raise ValueError("signals must have target_weight or signal_value")
    own = signals.select(*keys, "ts", "symbol", "strategy_id", finite(F.col(wanted), 0.0).alias("target"))
    if weights is not None and not weights.isEmpty():
        own = own.join(weights.select("strategy_id", F.col("weight").cast("double").alias("w")), "strategy_id", "left")
        own = own.withColumn("target", F.col("target") * F.coalesce("w", F.lit(0.0)))
    return own.groupBy(*keys, "ts", "symbol").agg(F.sum("target").alias("target"))


def price_grid(prices: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ts, symbol, price, prev_price, target`` for each time and symbol of a portfolio, filled forward; targets must stand at a price's time."""
    keys, place = list(keys), [*keys, "ts", "symbol"]
    close = prices.select(*place, finite(F.col("close")).alias("price"), F.struct(*(c for c in prices.columns if c not in place)).alias("row"))
    close = close.where("ts IS NOT NULL AND symbol IS NOT NULL AND price IS NOT NULL")
    close = close.groupBy(*place).agg(F.max(F.struct("row", "price"))["price"].alias("price"))
    times, symbols = close.select(*keys, "ts").distinct(), close.select(*keys, "symbol").distinct()
    # the grid is the result, so no row is made in vain; symbols go to every part of the times
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    grid = times.withColumn("part", F.pmod(F.hash("ts"), F.lit(SPREAD))).join(symbols.withColumn("part", parts), [*keys, "part"]).drop("part")
    series = Series((*keys, "symbol"))
    own, before = series.running(), series.ordered()
    # a target that another symbol has at this time, and this one hasn't, is a gap, as in a wide table
    rows = grid.join(close, place, "left").join(targets, place, "left")
    rows = rows.withColumns({"price": F.last("price", ignorenulls=True).over(own), "target": F.coalesce(F.last("target", ignorenulls=True).over(own), F.lit(0.0))})
    return rows.withColumn("prev_price", F.lag("price").over(before))


def _bounds(fee: float, keys: list[str]):
    """Scan step over sums of bars: the range that the growth of pre-trade equity up to each bar has; state is the last bar's most turnover."""

    def step(state: float | None, rows: pa.Table, final: bool):
        most, low, high = state, [], []
        for gain, now, before in zip(*(rows.column(c).to_pylist() for c in ("gain", "weights", "moved"))):
            if most is None:  # nothing is held before the first bar
                lo = hi = 1.0
                most = now
            else:
                spare = 1e-9 * (1 + abs(gain))
                lo, hi = 1 + gain - fee * most - spare, 1 + gain + fee * most + spare
                least = lo if lo > 0 else 0.0
                most = now + before / least if least > 1e-6 and math.isfinite(most) else math.inf
            low.append(lo if math.isfinite(lo) else -math.inf)
            high.append(hi if math.isfinite(hi) else math.inf)
        shown = [*keys, "ts"]
        return most, pa.table([*(rows.column(c) for c in shown), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=[*shown, "low", "high"])

    return step


def _chain(capital: float, fee: float, keys: list[str]):
    """Scan step over bars: state is (pre-trade equity before, equity, what was traded, rebalances)."""

    def step(state, rows: pa.Table, final: bool):
        before, last, traded, count = state or (None, capital, 0.0, 0)
        out = []
        for r in rows.to_pylist():
            pre = capital if before is None else before * (1 + r["gain"]) - fee * traded
            if not before:
                traded = abs(pre) * r["signed"]
            else:
                g = pre / before
                breaks = sum(x["size"] * abs(g - x["at"]) for x in r["breaks"])
                traded = abs(before) * (r["slope"] * g + r["constant"] + breaks)
            count += traded > EPS
            equity, net, gross = pre - fee * traded, pre * r["net"], abs(pre) * r["weights"]
            drift = (abs(pre / max(equity, EPS) - 1) * r["weights"] + r["unheld"]) / r["known"] if r["known"] else 0.0
            out.append((pre, equity, equity - net, gross, net, gross / equity if equity > 0 else 0.0, traded / max(last, EPS), count, drift))
            before, last = pre, equity
        names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
        columns = [pa.array(c, pa.int64() if n == "rebalance_count" else pa.float64()) for n, c in zip(names, zip(*out))]
        shown = [*keys, "ts"]
        return (before, last, traded, count), pa.table([*(rows.column(c) for c in shown), *columns], names=[*shown, *names])

    return step


def portfolio_equity(grid: DataFrame, capital: float = 100.0, fee_pct: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each time of a portfolio: equity before and after trading, cash, exposures, leverage, turnover, rebalances so far, drift."""
    own = list(keys) or ["portfolio"]
    rows = grid if keys else grid.withColumn("portfolio", F.lit(0))
    price, held = F.col("price"), F.col("price").isNotNull() & (F.col("price") != 0)
    rows = rows.select(*own, "ts", "symbol", "target", "price", "prev_price", F.when(held, F.col("target")).otherwise(0.0).alias("a"))
    last = F.coalesce(F.lag("a").over(Series((*own, "symbol")).ordered()), F.lit(0.0))
    grown = F.coalesce(price / F.when(F.col("prev_price") != 0, F.col("prev_price")), F.lit(0.0))
    rows = rows.withColumns({"b": last * grown, "lost": last * (grown - 1)})
    size, sign = F.abs("a"), F.when(price < 0, -1.0).otherwise(1.0)
    sums = rows.groupBy(*own, "ts").agg(
        F.sum("lost").alias("gain"),
        F.sum(size).alias("weights"),
        F.sum(F.abs("b")).alias("moved"),
        F.sum("a").alias("net"),
        F.sum(sign * size).alias("signed"),
        F.count(price).alias("known"),
        F.sum(F.when(price == 0, F.abs("target")).otherwise(0.0)).alias("unheld"),
    )
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*own, "ts"))
    ranges = scan(sums.select(*own, "ts", "gain", "weights", "moved"), Series(tuple(own)), _bounds(fee_pct, own), f"{kinds}, low double, high double")
    met = joined(rows, ranges, (*own, "ts"))
    at = F.col("b") / F.when(F.col("a") != 0, F.col("a"))
    side = F.when(at <= F.col("low"), 1.0).when(at >= F.col("high"), -1.0)
    lines = met.groupBy(*own, "ts").agg(
        F.coalesce(F.sum(sign * side * size), F.lit(0.0)).alias("slope"),
        F.sum(sign * F.when(at.isNull(), F.abs("b")).otherwise(F.coalesce(-side * size * at, F.lit(0.0)))).alias("constant"),
        F.collect_list(F.when(at.isNotNull() & side.isNull(), F.struct(at.alias("at"), (sign * size).alias("size")))).alias("breaks"),  # those in a narrow range
    )
    out = scan(joined(sums, lines, (*own, "ts"), "inner"), Series(tuple(own)), _chain(capital, fee_pct, own), f"{kinds}, {_SCHEMA}")
    return out if keys else out.drop("portfolio")


def portfolio_positions(grid: DataFrame, equity: DataFrame, fee_pct: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each time and symbol of a portfolio: position, price, weights, and profit and fees so far.

    A symbol has no position, profit or fee before its first price.
    """
    rows = grid.join(equity.select(*keys, "ts", "pre_equity", "equity"), [*keys, "ts"])
    at = F.when(F.col("price") != 0, F.col("price"))
    own = Series((*keys, "symbol"))
    rows = rows.withColumn("position", F.coalesce(F.col("target") * F.col("pre_equity") / at, F.lit(0.0)))
    held = F.coalesce(F.lag("position").over(own.ordered()), F.lit(0.0))
    rows = rows.withColumns({
        "pnl": F.coalesce(held * (F.col("price") - F.col("prev_price")), F.lit(0.0)),
        "fee": F.coalesce(F.abs(F.col("position") - held) * F.col("price") * fee_pct, F.lit(0.0)),
    })
    value = F.coalesce(F.col("position") * F.col("price"), F.lit(0.0))
    return rows.select(
        *keys,
        "ts",
        "symbol",
        "position",
        "price",
        F.col("target").alias("target_weight"),
        F.when(F.col("equity") > 0, value / F.col("equity")).otherwise(0.0).alias("actual_weight"),
        F.sum("pnl").over(own.running()).alias("pnl_by_symbol"),
        F.sum("fee").over(own.running()).alias("fee_by_symbol"),
    )


def portfolio_metrics(equity: DataFrame, calendar: str = "crypto_365", keys: Sequence[str] = ()) -> DataFrame:
    """One row a portfolio: period metrics, last exposures, summed turnover, rebalances and mean drift."""
    names = list(keys) or ["portfolio"]
    curve = stored(equity if keys else equity.withColumn("portfolio", F.lit(0)), "portfolio-curve")
    period = period_metrics(curve, Series(tuple(names)), calendar=calendar)
    own = curve.groupBy(*names).agg(
        *(F.max_by(c, "ts").alias(c) for c in ("gross_exposure", "net_exposure", "leverage")),
        F.sum("turnover").alias("turnover"),
        F.max("rebalance_count").alias("rebalance_count"),
        F.avg("drift_from_target").alias("drift_from_target"),
    )
    out = period.join(own, names)
    return out if keys else out.drop("portfolio")


def attribution(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, symbol, pnl, fee``: each symbol's final profit and fees."""
    return positions.groupBy(*keys, "symbol").agg(F.max_by("pnl_by_symbol", "ts").alias("pnl"), F.max_by("fee_by_symbol", "ts").alias("fee"))


def closed_form_equity(grid: DataFrame, capital: float = 100.0, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ts, equity`` without fees: the running product of growth, by blocks if there are very many times."""
    before = F.coalesce(F.lag("target").over(Series((*keys, "symbol")).ordered()), F.lit(0.0))
    gain = F.coalesce(before * (F.col("price") / F.when(F.col("prev_price") != 0, F.col("prev_price")) - 1), F.lit(0.0))
    own = list(keys) or ["portfolio"]
    rows = grid if keys else grid.withColumn("portfolio", F.lit(0))
    growth = rows.withColumn("gain", gain).groupBy(*own, "ts").agg((1 + F.sum("gain")).alias("g"))
    growth, series = stored(growth, "growth"), Series(tuple(own))  # a row a time
    if has_long_series(growth, series):
        blocks = deal(growth, series)
        grown = blocks.running(blocks.rows, "grown", F.col("g"), "product")
    else:
        grown = growth.withColumn("grown", F.product("g").over(series.running()))
    return grown.select(*keys, "ts", (F.col("grown") * capital).alias("equity"))
