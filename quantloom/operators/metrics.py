"""Trade, period and drawdown metrics of equity curves and trades, one row per series.

Values are unrounded; ``rounded_metrics`` rounds as reports show them. Windows and sums share one
shuffle on the series' keys, unless a series is long: then peaks, returns and rolling frames come from
blocks (see ``functions.blocks``), quantiles from counted values dealt by range, and all else from sums
that are merged, so no task has a whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import Blocks, deal, grouped_quantile, has_long_series, joined
from ..functions.series import Series, finite, seconds_between

EPS = 1e-12
YEAR_DAYS = {"crypto_365": 365.0, "trading_252": 252.0}


def _or_zero(value: Column) -> Column:
    return finite(value, 0.0)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b isn't above EPS."""
    return _or_zero(F.when(b > EPS, a / F.when(b != 0, b)))


def _finite_rows(curve: DataFrame, series: Series, value: str) -> DataFrame:
    return curve.select(*series.keys, series.ts, finite(F.col(value)).alias("e")).where("e IS NOT NULL")


def _returns(rows: DataFrame, ts: str, order: Window) -> DataFrame:
    before = F.lag("e").over(order)
    r = F.col("e") / F.when(before != 0, before) - 1
    return rows.withColumns({"r": finite(r), "dt": seconds_between(F.lag(ts).over(order), F.col(ts))})


def period_returns(curve: DataFrame, series: Series, value: str = "equity") -> DataFrame:
    """Finite rows of ``curve`` with ``e``, the return ``r`` on the row before, and seconds ``dt`` since then."""
    return _returns(_finite_rows(curve, series, value), series.ts, series.ordered())


def _depth() -> Column:
    return F.coalesce((F.col("e") - F.col("peak")) / F.when(F.col("peak") > 0, F.col("peak")), F.lit(0.0))


def _low(ts: str) -> Column:
    """The first deepest drawdown: depth, time and peak."""
    return F.min(F.struct("dd", F.col(ts).alias("at"), "peak"))


def _drawdown(rows: DataFrame, series: Series) -> DataFrame:
    """Rows with ``low``, the struct (depth, ts, peak) of the series' first deepest drawdown."""
    rows = rows.withColumn("peak", F.max("e").over(series.running())).withColumn("dd", _depth())
    return rows.withColumn("low", _low(series.ts).over(series.whole()))


def _drawdown_long(blocks: Blocks, rows: DataFrame, ts: str) -> DataFrame:
    """``_drawdown`` with the peaks of blocks carried over their borders and the lows merged."""
    rows = blocks.running(rows, "peak", F.col("e"), "max").withColumn("dd", _depth())
    return joined(rows, rows.groupBy(*blocks.keys).agg(_low(ts).alias("low")), blocks.keys)


def _drawdown_sums(ts: str) -> list[Column]:
    t, e, low = F.col(ts), F.col("e"), F.col("low")
    top = e >= low["peak"] - EPS
    return [
        F.min(low).alias("low"),
        F.min(F.when(top & (t <= low["at"]), t)).alias("dd_start"),
        F.min(F.when(top & (t > low["at"]), t)).alias("dd_recovery"),
        F.max(t).alias("t_n"),
    ]


def _drawdown_columns() -> dict[str, Column]:
    start, low = F.coalesce("dd_start", "low.at"), F.col("low")
    return {
        "max_drawdown_pct": F.abs(low["dd"]) * 100,
        "max_drawdown_start": start,
        "max_drawdown_end": low["at"],
        "max_drawdown_recovery": F.col("dd_recovery"),
        "max_drawdown_duration_days": F.greatest(seconds_between(start, F.coalesce("dd_recovery", "t_n")) / 86400, F.lit(0.0)),
    }


def drawdowns(curve: DataFrame, series: Series, value: str = "equity") -> DataFrame:
    """Depth, start, end, recovery and length of each series' deepest drawdown."""
    rows = _finite_rows(curve, series, value)
    if has_long_series(rows, series):
        blocks = deal(rows, series)
        rows = _drawdown_long(blocks, blocks.rows, series.ts)
    else:
        rows = _drawdown(rows, series)
    sums = rows.groupBy(*series.keys).agg(*_drawdown_sums(series.ts))
    return sums.select(*series.keys, *(v.alias(k) for k, v in _drawdown_columns().items()))


def _rolled(frame: Window, window: int) -> dict[str, Column]:
    """Mean over deviation, and over that of losses, of the last ``window`` returns."""
    r = F.col("r")
    full, mean = F.count("r").over(frame) >= window, F.avg("r").over(frame)
    steady = F.stddev_pop(F.when(r < 0, r).when(r.isNotNull(), 0.0)).over(frame)
    deviation = F.stddev_pop("r").over(frame)
    return {"roll": F.when(full, mean / F.when(deviation != 0, deviation)), "roll_down": F.when(full, mean / F.when(steady != 0, steady))}


def _last_rolled(t: Column) -> list[Column]:
    return [F.max_by(c, F.when(F.col(c).isNotNull(), t)).alias(c) for c in ("roll", "roll_down")]


def _period_sums(ts: str) -> list[Column]:
    t, r = F.col(ts), F.col("r")
    return [
        *_drawdown_sums(ts),
        F.count("*").alias("points"),
        F.count("r").alias("n"),
        F.min(t).alias("t_0"),
        F.min_by("e", t).alias("e_0"),
        F.max_by("e", t).alias("e_n"),
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("std"),
        F.stddev_pop(F.when(r < 0, r)).alias("down"),
        F.skewness("r").alias("g1"),
        F.kurtosis("r").alias("g2"),
        F.max("var").alias("var"),
        F.avg(F.when(r <= F.col("var"), r)).alias("cvar"),
    ]


def _sums(rows: DataFrame, series: Series, window: int) -> DataFrame:
    """What period metrics follow from, a row a series."""
    keys, ts, has = list(series.keys), series.ts, F.col("r").isNotNull()
    rows = _drawdown(_returns(rows, ts, series.ordered()), series)
    # returns are ranked among themselves, so that a row without one takes no place in a frame
    frame = Window.partitionBy(*keys, has).orderBy(ts).rowsBetween(1 - window, 0)
    rows = rows.withColumns(_rolled(frame, window) | {"var": F.percentile("r", F.lit(0.05)).over(series.whole())})
    spacing = F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5))
    return rows.groupBy(*keys).agg(*_period_sums(ts), spacing.alias("spacing"), *_last_rolled(F.col(ts)))


def _sums_long(rows: DataFrame, series: Series, window: int) -> DataFrame:
    """``_sums`` without a task that has a whole series."""
    keys, ts = list(series.keys), series.ts
    blocks = deal(rows, series)
    rows = _returns(blocks.with_halo(1), ts, blocks.series.ordered()).where("NOT __halo")
    returns = deal(rows.where("r IS NOT NULL").select(*keys, ts, "r"), series)
    frame = returns.series.last_rows(window)
    rolled = returns.with_halo(window - 1).withColumns(_rolled(frame, window)).where("NOT __halo").groupBy(*keys).agg(*_last_rolled(F.col(ts)))
    var = grouped_quantile(returns.rows, keys, "r", 0.05, "var")
    spacing = grouped_quantile(rows.where("dt > 0"), keys, "dt", 0.5, "spacing")
    rows = joined(_drawdown_long(blocks, rows, ts), var, keys)
    out = rows.groupBy(*keys).agg(*_period_sums(ts))
    return joined(joined(out, spacing, keys), rolled, keys)


def period_metrics(curve: DataFrame, series: Series, value: str = "equity", *, periods_per_year: float | None = None, calendar: str = "crypto_365", rolling_window: int = 30) -> DataFrame:
    """Return, risk and drawdown metrics of each equity curve; series without a finite value give no row."""
    keys, rows = list(series.keys), _finite_rows(curve, series, value)
    sums = (_sums_long if has_long_series(rows, series) else _sums)(rows, series, max(int(rolling_window), 2))
    days = YEAR_DAYS["trading_252" if calendar == "trading_252" else "crypto_365"]
    default = 365.0 if calendar == "crypto_365" else 252.0
    inferred = F.coalesce(F.greatest(days * 86400 / F.col("spacing"), F.lit(1.0)), F.lit(default))
    ppy = F.lit(float(periods_per_year)) if periods_per_year is not None else inferred
    year, n = F.sqrt(ppy), F.col("n")
    years = F.greatest(seconds_between(F.col("t_0"), F.col("t_n")) / (365 * 86400), F.lit(1 / 365))
    grown = F.when((F.col("e_0") > EPS) & (F.col("e_n") > EPS), F.ln(F.col("e_n") / F.when(F.col("e_0") > 0, F.col("e_0"))) / years)
    cagr = F.coalesce(F.exp(F.greatest(F.least(grown, F.lit(700.0)), F.lit(-700.0))) - 1, F.lit(0.0))
    dd = _drawdown_columns()
    depth = F.round(dd["max_drawdown_pct"], 6) / 100
    skew = F.when(n >= 3, F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)) * F.col("g1"))
    kurtosis = F.when(n >= 4, (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * F.col("g2") + 6))
    down = F.coalesce("down", F.lit(0.0))
    return sums.select(
        *keys,
        "points",
        ppy.alias("periods_per_year"),
        (_ratio(F.col("mean"), F.col("std")) * year).alias("period_sharpe"),
        (_ratio(F.col("mean"), down) * year).alias("sortino"),
        _or_zero(F.col("roll") * year).alias("rolling_sharpe"),
        _or_zero(F.col("roll_down") * year).alias("rolling_sortino"),
        _or_zero(F.col("std") * year * 100).alias("volatility_annualized"),
        _or_zero(down * year * 100).alias("downside_volatility"),
        cagr.alias("cagr"),
        (cagr * 100).alias("cagr_pct"),
        _ratio(cagr, depth).alias("calmar"),
        _or_zero(F.when(F.col("e_0") > EPS, (F.col("e_n") / F.when(F.col("e_0") != 0, F.col("e_0")) - 1) * 100)).alias("return_pct"),
        _or_zero(F.col("var") * 100).alias("VaR_95"),
        _or_zero(F.col("cvar") * 100).alias("CVaR_95"),
        _or_zero(skew).alias("skew"),
        _or_zero(kurtosis).alias("kurtosis"),
        *(v.alias(k) for k, v in dd.items()),
    )


TRADE_METRICS = ("trade_sharpe", "profit_factor", "win_rate", "avg_trade_return", "median_trade_return", "best_trade", "worst_trade", "avg_holding_bars", "avg_holding_time", "time_in_market_pct", "turnover", "fee_drag", "slippage_drag", "gross_pnl", "net_pnl", "num_trades", "trades_per_year")


def trade_metrics(trades: DataFrame, keys: Sequence[str], *, total_days: Column, equity_points: Column | None = None, long: bool | None = None) -> DataFrame:
    """Metrics of the trades of each group; ``total_days`` and ``equity_points`` are columns of ``trades``, constant in a group.

    ``long`` tells whether some group has too many trades for one task; by default large inputs are counted.
    """
    cash, account, pct = _or_zero(F.col("pnl_cash")), _or_zero(F.col("account_return_pct")) / 100, _or_zero(F.col("pnl_pct"))
    held = F.greatest(seconds_between(F.col("entry_ts"), F.col("exit_ts")) / 86400, F.lit(0.0))
    long = has_long_series(trades, Series(tuple(keys), "exit_ts", long))
    medians = grouped_quantile(trades.select(*keys, pct.alias("pct")), keys, "pct", 0.5, "median_trade_return") if long else None
    sums = trades.groupBy(*keys).agg(
        F.count("*").alias("num_trades"),
        F.max(F.greatest(total_days.cast("double"), F.lit(1.0))).alias("days"),
        F.max(equity_points if equity_points is not None else F.lit(0)).alias("points"),
        F.avg(account).alias("mean"),
        F.stddev_pop(account).alias("std"),
        F.sum(F.when(cash > 0, cash).otherwise(0.0)).alias("gross_pnl"),
        F.sum(F.when(cash < 0, -cash).otherwise(0.0)).alias("lost"),
        F.sum(cash).alias("net_pnl"),
        (F.avg(F.when(account > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate"),
        F.avg(pct).alias("avg_trade_return"),
        *([] if long else [F.percentile(pct, F.lit(0.5)).alias("median_trade_return")]),
        F.max(pct).alias("best_trade"),
        F.min(pct).alias("worst_trade"),
        F.avg(_or_zero(F.col("bars_held"))).alias("avg_holding_bars"),
        F.sum(_or_zero(F.col("bars_held"))).alias("bars"),
        F.coalesce(F.avg(held), F.lit(0.0)).alias("avg_holding_time"),
        F.sum(F.abs(_or_zero(F.col("allocated_capital")))).alias("turnover"),
        F.sum(_or_zero(F.col("fee_cash"))).alias("fee_drag"),
        F.sum(_or_zero(F.col("slippage_cash"))).alias("slippage_drag"),
    )
    sums = joined(sums, medians, keys) if long else sums
    per_year = F.col("num_trades") / F.col("days") * 365
    sums = sums.withColumns({
        "trades_per_year": per_year,
        "trade_sharpe": F.when(F.col("num_trades") >= 2, _ratio(F.col("mean"), F.col("std")) * F.sqrt(F.greatest(per_year, F.lit(EPS)))).otherwise(0.0),
        "profit_factor": F.when(F.col("lost") > EPS, F.col("gross_pnl") / F.when(F.col("lost") != 0, F.col("lost"))).otherwise(F.col("gross_pnl")),
        "time_in_market_pct": F.when(F.col("points") > 0, F.least(F.col("bars") / F.when(F.col("points") > 0, F.col("points")), F.lit(1.0)) * 100).otherwise(0.0),
    })
    return sums.select(*keys, *TRADE_METRICS)


def strategy_metrics(curve: DataFrame, trades: DataFrame, series: Series, *, periods_per_year: float | None = None, calendar: str = "crypto_365") -> DataFrame:
    """All metrics of each strategy: period metrics of its curve joined with metrics of its trades (zero without trades)."""
    keys = list(series.keys)
    period = period_metrics(curve, series, periods_per_year=periods_per_year, calendar=calendar)
    spans = curve.groupBy(*keys).agg(F.count("*").alias("points_all"), F.min(series.ts).alias("usable_start"), F.max(series.ts).alias("usable_end"), F.min_by("equity", series.ts).alias("first_equity"), F.max_by("equity", series.ts).alias("last_equity"))
    days = F.greatest(seconds_between(F.col("usable_start"), F.col("usable_end")) / 86400, F.lit(1.0))
    long = has_long_series(trades, Series(tuple(keys), "exit_ts", series.long))  # a join's size can't be estimated
    own = trade_metrics(trades.join(spans, keys), keys, total_days=days, equity_points=F.col("points_all"), long=long)
    out = spans.join(period, keys, "left").join(own, keys, "left").fillna(0, [m for m in TRADE_METRICS if m != "num_trades"]).fillna(0, ["num_trades"])
    both = (F.col("first_equity") > 0) & (F.col("last_equity") > 0)
    return out.select(
        *keys,
        "usable_start",
        "usable_end",
        F.col("points_all").alias("usable_rows"),
        F.when(both, F.col("return_pct")).otherwise(0.0).alias("return_pct"),
        F.col("trade_sharpe").alias("sharpe"),
        F.when(both, F.col("max_drawdown_pct")).otherwise(0.0).alias("max_drawdown"),
        (F.col("last_equity") - F.col("first_equity")).alias("net_profit"),
        F.col("avg_trade_return").alias("avg_trade_pct"),
        *(c for c in period.columns if c not in (*keys, "points", "periods_per_year", "return_pct")),
        *TRADE_METRICS,
    )


#: Digits of each metric in reports.
PLACES = dict.fromkeys(("return_pct", "max_drawdown", "net_profit", "cagr_pct", "win_rate", "avg_trade_pct"), 2) | dict.fromkeys(("cagr", "fee_drag", "slippage_drag", "gross_pnl", "net_pnl"), 6)


def rounded_metrics(metrics: DataFrame, places: dict[str, int] = PLACES, default: int = 3) -> DataFrame:
    """Metrics rounded, drawdown dates as text."""
    numbers = {f.name: F.round(f.name, places.get(f.name, default)) for f in metrics.schema if f.dataType.simpleString() == "double"}
    dates = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in metrics.columns if c in ("max_drawdown_start", "max_drawdown_end", "max_drawdown_recovery")}
    return metrics.withColumns(numbers | dates)
