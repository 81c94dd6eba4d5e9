"""Order-management analytics: order outcomes, execution quality, exposure and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.series import Series, exact_quantile, finite, number
from ..sources.shared import stored
from .align import asof, time_of
from .metrics import period_metrics

#: Statuses that count as filled, cancelled and rejected, and sides that sell.
FILLED, CANCELLED, REJECTED = ("filled", "partially_filled", "partial"), ("cancelled", "canceled"), ("rejected", "reject")
SELLS = ("sell", "short")


def order_ratios(orders: DataFrame) -> DataFrame:
    """One row: ``fill_ratio, cancel_ratio, reject_ratio`` over all order events; zeros without any."""
    status = F.lower(F.col("status").cast("string"))
    total = F.count("*")
    names = {"fill_ratio": FILLED, "cancel_ratio": CANCELLED, "reject_ratio": REJECTED}
    return orders.agg(*(F.coalesce(F.count_if(status.isin(*s)) / F.when(total > 0, total), F.lit(0.0)).alias(n) for n, s in names.items()))


def slippage_bps(fills: DataFrame, signed: bool = True) -> Column:
    """Basis points by which fills were worse than the arrival price; null where that is near zero.

    Sides that sell change the sign if ``signed``; a missing side buys.
    """
    fill, arrival = finite(F.col("fill_price")), finite(F.col("arrival_price"))
    worse = fill - arrival
    if signed and "side" in fills.columns:
        worse = F.when(F.lower(F.coalesce(F.col("side").cast("string"), F.lit("buy"))).isin(*SELLS), -worse).otherwise(worse)
    return finite(worse / F.when(F.abs(arrival) > 1e-12, arrival) * 10000)


def execution_quality(fills: DataFrame) -> DataFrame:
    """One row: slippage mean and median, shortfall, mean latency and summed fees."""
    kept = {"bps": slippage_bps(fills), "fee": finite(F.col("fee"), 0.0) if "fee" in fills.columns else F.lit(0.0)}
    kept["latency"] = number("latency_ms") if "latency_ms" in fills.columns else F.lit(0.0)
    fills = stored(fills.select(*(v.alias(k) for k, v in kept.items())), "fills")  # read for the means and for the median
    bps, fee, latency = F.col("bps"), F.sum("fee"), F.avg("latency")
    middle = exact_quantile(fills.select(bps), 0.5, "median")
    own = fills.agg(
        F.coalesce(F.avg(bps), F.lit(0.0)).alias("average_slippage_bps"),
        F.coalesce(F.avg(bps), F.lit(0.0)).alias("implementation_shortfall"),
        latency.alias("latency_ms"),
        F.coalesce(fee, F.lit(0.0)).alias("fee_drag"),
        F.lit(0.0).alias("funding_drag"),
    )
    own = own.crossJoin(middle)  # one row each
    return own.select("average_slippage_bps", F.coalesce("median", F.lit(0.0)).alias("median_slippage_bps"), "implementation_shortfall", "latency_ms", "fee_drag", "funding_drag")


def venue_quality(fills: DataFrame) -> DataFrame:
    """``venue, avg_slippage_bps, fills``: slippage without regard to the side, and all fills."""
    bps = slippage_bps(fills, signed=False)
    return fills.where("venue IS NOT NULL").groupBy("venue").agg(F.coalesce(F.avg(bps), F.lit(0.0)).alias("avg_slippage_bps"), F.count("*").alias("fills"))


def position_pnl(positions: DataFrame) -> DataFrame:
    """One row: realized and unrealized profit summed over all snapshots."""
    names = ("realized_pnl", "unrealized_pnl")
    return positions.agg(*(F.coalesce(F.sum(finite(F.col(c), 0.0)), F.lit(0.0)).alias(c) if c in positions.columns else F.lit(0.0).alias(c) for c in names))


def exposure_by_symbol(positions: DataFrame) -> DataFrame:
    """``symbol, exposure`` at the latest time of all positions."""
    latest = positions.agg(F.max("ts").alias("ts"))
    value = finite(F.col("quantity"), 0.0) * finite(F.col("mark_price"), 0.0)
    return positions.join(latest, "ts", "left_semi").groupBy("symbol").agg(F.sum(value).alias("exposure"))


def target_drift(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """One row, ``target_vs_actual_position_drift``: mean distance of positions from the last target of their symbol."""
    joined = asof(positions.select("symbol", "ts", "quantity"), targets, on=time_of("ts"), right_on=time_of("ts"), columns={"target": number("target_quantity")}, by=["symbol"])
    drift = F.abs(number("quantity") - F.col("match.target"))
    return joined.agg(F.coalesce(F.avg(drift), F.lit(0.0)).alias("target_vs_actual_position_drift"))


def equity_risk(equity: DataFrame, calendar: str = "crypto_365", by: Sequence[str] = ()) -> DataFrame:
    """Period Sharpe ratio and drawdown of equity snapshots: a row for each account ``by``, or one row, zeros without any."""
    own = equity.where("ts IS NOT NULL")
    keys = list(by) or ["account"]
    own = period_metrics(own if by else own.withColumn("account", F.lit(0)), Series(tuple(keys)), calendar=calendar)
    return own.groupBy(*by).agg(F.coalesce(F.max("period_sharpe"), F.lit(0.0)).alias("OMS_period_sharpe"), F.coalesce(F.max("max_drawdown_pct"), F.lit(0.0)).alias("live_rolling_drawdown"))


def oms_metrics(*, orders: DataFrame | None = None, fills: DataFrame | None = None, positions: DataFrame | None = None, equity: DataFrame | None = None, targets: DataFrame | None = None, calendar: str = "crypto_365") -> DataFrame:
    """One row of all metrics whose inputs are given, with exposure by symbol and quality by venue as maps."""
    parts = []
    if orders is not None:
        parts.append(order_ratios(orders))
    if fills is not None:
        parts.append(execution_quality(fills))
        if "venue" in fills.columns:
            entry = F.struct("venue", F.struct("avg_slippage_bps", "fills"))
            parts.append(venue_quality(fills).agg(F.map_from_entries(F.collect_list(entry)).alias("execution_quality_by_venue")))
    if positions is not None:
        parts.append(position_pnl(positions))
        parts.append(exposure_by_symbol(positions).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "exposure"))).alias("exposure_by_symbol")))
        if targets is not None:
            parts.append(target_drift(positions, targets))
    if equity is not None:
        parts.append(equity_risk(equity, calendar))
    if not parts:
        raise ValueError("no input")
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(more)  # one row each
    return out
