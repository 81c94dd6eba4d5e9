"""Registered queries of the engine's own operators over the generated tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions.conditions import Condition, Custom, cond, mask, register_condition
from .functions.series import Series
from .functions.transforms import apply_transform, register_transform
from .operators import align, metrics, montecarlo, oms, portfolio, quality
from .operators.backtest import trade_report
from .oracles import ORACLES as PLAIN_ORACLES
from .plan_oracles import ORACLES as PLAN_ORACLES
from .plans import research, views
from .plans.strategy import Backtest, Result, Sweep, new, sweep, time_slice
from .sources.shared import stored
from .sources import sinks
from .sources.market import bars_from_events, load_ohlc, load_signal
from .streaming.live import live_order_ratios, live_slippage

SERIES = Series()
#: Taken for too long for a task, whatever their size, so that blocks are used.
LONG = Series(long=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """Bars of each event type, the signal being the close."""
    return bars_from_events(table(spark, sf_dir, "events"), every).withColumn("signal", F.col("close"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded; a zero has no sign."""
    return df.withColumns({f.name: F.round(f.name, places) + 0.0 for f in df.schema if f.dataType.simpleString() == "double"})


def twice_rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to nine places first, so that values halfway between two roundings don't depend on the order of sums."""
    return rounded(rounded(df, 9))


def significant(value: Column, digits: int = 9) -> Column:
    """A number rounded to so many digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.when(value != 0, value)))) - (digits - 1))
    return F.when(value == 0, 0.0).otherwise(F.round(value / unit) * unit)


def transform_query(name: str, series: Series = SERIES, **options: object) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("x"))
        return rounded(apply_transform(own, name, "x", series, **options))

    return query


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = bars(spark, sf_dir), F.col("close")
    found = {"above": cond.above(100.0), "below": cond.below(50.0, inclusive=False), "cross_above": cond.cross_above(100.0), "cross_below": cond.cross_below(50.0, trigger_on_first_bar=False)}
    return own.select("symbol", "ts", *(mask(c, x, SERIES).alias(n) for n, c in found.items()))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one signal, known five minutes later."""
    return table(spark, sf_dir, "events").select(F.col("ts").alias("event_ts"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("available_ts"), F.col("value").alias("signal_value"))


def asof_query(direction: str, broadcast: bool | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = bars(spark, sf_dir).select("symbol", "ts", "close")
        out = align.align_signal_to_bars(own, event_signal(spark, sf_dir), direction=direction, tolerance="1h", min_lag="30s", broadcast=broadcast)
        return rounded(out.drop("alignment_method"))

    return query


def asof_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("signal_value"))
    return align.merge_signal_backward(bars(spark, sf_dir).select("symbol", "ts", "close"), signal, by=["symbol"])


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir)
    frames = {s: own.where(F.col("symbol") == s).select("ts", "close") for s in ("click", "view", "error", "signup", "purchase")}
    return align.align_on_time(frames, ["ts"])


def ohlc_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("open_time", F.unix_millis(F.date_trunc("minute", "ts").cast("timestamp")))
    raw = raw.groupBy("open_time").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return load_ohlc(raw.withColumn("close_time", F.col("open_time") + 60_000), volume_col="volume", start_ms=1_704_412_800_000, end_ms=1_705_622_400_000)


def signal_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_signal(table(spark, sf_dir, "events"), ts_col="ts", value_col="value", start="2024-01-05 00:00:00", end="2024-01-19 00:00:00", where="event_type = 'error'")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detrended running revenue of each order status, as equity by day."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("x"))
    off = F.col("x") - F.avg("x").over(SERIES.whole())
    return days.withColumn("off", off).select("symbol", "ts", (F.lit(1e8) + F.sum("off").over(SERIES.running())).alias("equity"))


def period_metrics(spark: SparkSession, sf_dir: str, series: Series = SERIES) -> DataFrame:
    out = metrics.period_metrics(curves(spark, sf_dir), series).drop("max_drawdown_start", "max_drawdown_end", "max_drawdown_recovery")
    return rounded(out, 4)


def drawdown(spark: SparkSession, sf_dir: str, series: Series = SERIES) -> DataFrame:
    return rounded(metrics.drawdowns(curves(spark, sf_dir), series), 4)


def period_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_metrics(spark, sf_dir, LONG)


def drawdown_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawdown(spark, sf_dir, LONG)


def backtest(spark: SparkSession, sf_dir: str, series: Series = SERIES) -> Backtest:
    plan = new(bars(spark, sf_dir), series=series).named("zscore").norm("zscore", window=20)
    plan = plan.entry(long=cond.cross_above(1.0), short=cond.cross_below(-1.0)).exit(long=cond.cross_below(0.0), short=cond.cross_above(0.0))
    return plan.risk(position_size_pct=0.05, fee_pct=0.001, slippage_pct=0.0005, take_profit_pct=40.0, stop_loss_pct=-30.0)


def backtest_trades(spark: SparkSession, sf_dir: str, series: Series = SERIES) -> DataFrame:
    return rounded(trade_report(backtest(spark, sf_dir, series).run().trades), 10)


def backtest_trades_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_trades(spark, sf_dir, LONG)


def backtest_equity_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_equity(spark, sf_dir, LONG)


def backtest_equity(spark: SparkSession, sf_dir: str, series: Series = SERIES) -> DataFrame:
    return rounded(backtest(spark, sf_dir, series).run().equity.select("symbol", "ts", "idx", "equity", "position", "benchmark_equity"), 4)


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded_metrics(rounded(backtest(spark, sf_dir).run().metrics(), 9))


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = backtest(spark, sf_dir).run().trades
    return rounded(metrics.trade_metrics(own, ["symbol"], total_days=F.lit(30.0), equity_points=F.lit(720)), 4)


def zscore_sweep(spark: SparkSession, sf_dir: str, wide: bool = False) -> Sweep:
    def build(base: Backtest, rolling_window: int, long_threshold: float, short_threshold: float, exit_signal: float | None, take_profit_pct: float | None, stop_loss_pct: float) -> Backtest:
        out = base.norm("zscore", window=rolling_window).entry(long=cond.cross_above(long_threshold), short=cond.cross_below(short_threshold))
        if exit_signal is not None:
            out = out.exit(long=cond.cross_below(exit_signal), short=cond.cross_above(exit_signal))
        return out.risk(position_size_pct=0.05, fee_pct=0.00055, take_profit_pct=take_profit_pct, stop_loss_pct=stop_loss_pct)

    grid = {"rolling_window": [10, 20, 40] if wide else [10, 20], "long_threshold": [0.5, 1.0], "short_threshold": [-1.0, -0.5], "exit_signal": [0.0, None], "take_profit_pct": [40.0, None] if wide else [40.0], "stop_loss_pct": [-30.0, -60.0] if wide else [-30.0]}
    return sweep(new(bars(spark, sf_dir)).named("sweep"), **grid).builder(build)


def sweep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid of 96 combinations over all series, best first."""
    return metrics.rounded_metrics(rounded(research.rank(zscore_sweep(spark, sf_dir, wide=True).table()), 9))


PROTOCOL = research.Protocol(in_sample=("2024-01-01", "2024-01-18"), out_sample=("2024-01-18", "2024-01-31"))


def research_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = zscore_sweep(spark, sf_dir)
    return plan.params().join(research.flat_research(plan.run(), PROTOCOL), "strategy_id")


def research_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twice_rounded(research_table(spark, sf_dir))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twice_rounded(research.walk_forward(zscore_sweep(spark, sf_dir), train_window="10D", test_window="5D", step="5D").folds)


def walk_forward_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = research.walk_forward(backtest(spark, sf_dir), train_window="10D", test_window="5D", step="5D")
    return twice_rounded(found.combined.join(found.stability, "symbol"))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = research_table(spark, sf_dir)
    out = research.parameter_stability(own, ["rolling_window", "long_threshold", "short_threshold", "exit_signal"], by=["symbol"])
    return twice_rounded(out.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in ("best_params", "best_is_params", "best_oos_params")}))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir, "day")
    own = Window.partitionBy("ts")
    signals = prices.select("ts", "symbol", (F.col("volume") / F.sum("volume").over(own)).alias("target_weight"))
    signals = signals.withColumn("strategy_id", F.explode(F.array(F.lit("s1"), F.lit("s2"))))
    weights = spark.createDataFrame([("s1", 0.10), ("s2", 0.05)], "strategy_id string, weight double")
    return portfolio.price_grid(prices, portfolio.net_targets(signals, weights))


def portfolio_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.portfolio_equity(grid(spark, sf_dir), fee_pct=0.001))


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(grid(spark, sf_dir), "grid")
    return rounded(portfolio.portfolio_positions(own, portfolio.portfolio_equity(own, fee_pct=0.001), 0.001))


def portfolio_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.attribution(portfolio_positions(spark, sf_dir)), 4)


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = portfolio.portfolio_metrics(portfolio.portfolio_equity(grid(spark, sf_dir), fee_pct=0.001))
    # a year's growth of so short a curve has dozens of digits
    grown = ["cagr", "cagr_pct", "calmar"]
    return rounded(out.drop(*grown)).crossJoin(out.select(*(significant(F.col(c)).alias(c) for c in grown)))  # one row each


def portfolio_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.closed_form_equity(grid(spark, sf_dir)))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Filled").when(F.col("o_orderstatus") == "P", "partially_filled").otherwise("CANCELLED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("string").alias("order_id"), status.alias("status"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    own = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    side: Column = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return own.select(F.col("l_shipdate").alias("ts"), side.alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"), F.col("p_retailprice").alias("arrival_price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"), F.col("s_nationkey").cast("string").alias("venue"), (F.col("l_quantity") * 10).alias("latency_ms"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running event values of each user as a position marked at the last value."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "value", F.col("ts").alias("at"))
    days = events.groupBy("symbol", "ts").agg(F.sum("value").alias("x"), F.max_by("value", "at").alias("mark_price"))
    quantity = F.sum("x").over(SERIES.running())
    return days.select("symbol", "ts", quantity.alias("quantity"), "mark_price", F.col("x").alias("realized_pnl"), (quantity * 0.01).alias("unrealized_pnl"))


def oms_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oms.order_ratios(order_events(spark, sf_dir)))


def oms_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oms.execution_quality(fills(spark, sf_dir)), 3)


def oms_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oms.venue_quality(fills(spark, sf_dir)), 3)


def oms_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oms.exposure_by_symbol(positions(spark, sf_dir)), 4)


def oms_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = positions(spark, sf_dir)
    targets = own.select("symbol", (F.col("ts") - F.expr("INTERVAL 36 HOURS")).alias("ts"), (F.col("quantity") * 1.1).alias("target_quantity"))
    return rounded(oms.target_drift(own, targets).join(oms.position_pnl(own)), 3)


def oms_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(oms.equity_risk(curves(spark, sf_dir), by=["symbol"]))


def live_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(live_order_ratios(order_events(spark, sf_dir), "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


def live_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(live_slippage(fills(spark, sf_dir), "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 3)


def order_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small returns, one an account: balances of customers in order of their keys."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_idx"), (F.col("c_acctbal") / 2000).alias("account_return_pct"))
    return montecarlo.trade_returns(own, ["entry_idx"])


def monte_carlo(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = montecarlo.robustness(order_returns(spark, sf_dir), n_sims=200, seed=7, method=method)
        ends = [c for c in out.columns if c.startswith("terminal")]
        return rounded(out.drop(*ends)).crossJoin(out.select(*(significant(F.col(c)).alias(c) for c in ends)))  # one row each

    return query


def ohlc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir)
    bad = own.withColumns({"high": F.when(F.hour("ts") == 3, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(F.hour("ts") == 5, -F.col("close")).otherwise(F.col("close")), "volume": F.when(F.hour("ts") == 7, None).otherwise(F.col("volume"))})
    doubled = bad.union(bad.where(F.hour("ts") == 9))
    return quality.validate_ohlc(doubled, expected_freq="1h", by=["symbol"]).drop("message")


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with times and values that can't be read, in an order of arrival that isn't that of time."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "ts", F.col("value").cast("string").alias("close"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return own.withColumns({"ts": F.when(F.col("event_id") % 97 == 0, "never").otherwise(text), "close": F.when(F.col("event_id") % 89 == 0, "none").when(F.col("event_id") % 83 == 0, "Infinity").otherwise(F.col("close"))})


def ohlc_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = unreadable(spark, sf_dir).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    own = own.withColumn("at", F.when(F.col("symbol") == "error", -F.col("event_id")).otherwise(F.col("event_id")))
    return quality.validate_ohlc(own, sequence_col="at", by=["symbol"]).drop("message")


def signal_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = unreadable(spark, sf_dir).withColumnRenamed("close", "signal")
    own = own.withColumns({"event_ts": F.when(F.col("event_id") % 79 == 0, "never").otherwise(F.col("ts")), "available_ts": F.when(F.col("event_id") % 73 == 0, None).otherwise(F.col("ts"))})
    return quality.validate_signal(own, event_ts_col="event_ts", available_ts_col="available_ts", by=["symbol"]).drop("message")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("x"))
    return rounded(apply_transform(apply_transform(own, "sma", "x", SERIES, window=24), "pct_change", "x", SERIES))


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms start cold in a slice of time whose end is left out."""
    own = time_slice(bars(spark, sf_dir), "ts", "2024-01-05", "2024-01-12 06:00:00", inclusive_end=False)
    return rounded(apply_transform(own.select("symbol", "ts", F.col("close").alias("x")), "sma", "x", SERIES, window=12))


def _two_rises(values: np.ndarray) -> np.ndarray:
    """Whether a value is the second rise in a row."""
    up = np.concatenate(([False], values[1:] > values[:-1]))
    return up & np.concatenate(([False], up[:-1]))


def custom_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Custom(_two_rises, 2)
    return own.added(bars(spark, sf_dir), "close", SERIES).select("symbol", "ts", mask(own, F.col("close"), SERIES).alias("hit"))


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail payloads of the backtest of each series, read back field by field."""
    plan = backtest(spark, sf_dir).params(long_threshold=1.0, short_threshold=-1.0)
    result = plan.run().stored()
    levels = spark.createDataFrame([(plan.strategy.strategy_id, 1.0, -1.0)], "strategy_id string, long_threshold double, short_threshold double")
    out = views.detail_payload(result.rows, result.trades, result.metrics(), SERIES, levels, 200)
    chart = "$.chart_data.price_signal_chart."
    fields = {"usable_rows": "$.usable_rows", "last_exit": "$.trades[0].exit_date", "trades": "$.debug_summary.trades", "first_point": chart + "dates[0]", "first_exit": chart + "exit_dates[0]", "short_line": chart + "short_threshold", "exit_line": chart + "exit_threshold", "benchmark": "$.benchmark.name"}
    sizes = {"n_points": chart + "dates", "n_long": chart + "entry_long_dates", "n_short": chart + "entry_short_prices", "n_curve": "$.chart_data.equity_chart.strategy_equity", "n_trades": "$.trades"}
    return out.select("symbol", *(F.get_json_object("payload", p).alias(n) for n, p in fields.items()), *(F.json_array_length(F.get_json_object("payload", p)).alias(n) for n, p in sizes.items()))


def folio_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(grid(spark, sf_dir), "grid")
    equity = portfolio.portfolio_equity(own, fee_pct=0.001)
    positions = portfolio.portfolio_positions(own, equity, 0.001)
    out = views.portfolio_payload("folio", portfolio.portfolio_metrics(equity), equity, positions, portfolio.attribution(positions))
    sizes = {"n_equity": "$.equity", "n_positions": "$.positions"}
    fields = {"name": "$.name", "first_ts": "$.equity[0].ts", "first_symbol": "$.positions[0].symbol", "points": "$.metrics.points"}
    return out.select(*(F.get_json_object("payload", p).alias(n) for n, p in fields.items()), *(F.json_array_length(F.get_json_object("payload", p)).alias(n) for n, p in sizes.items()))


def customers_as_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sweep's results: balances as ratios, nation and segment as parameters."""
    own = table(spark, sf_dir, "customer")
    return own.select(F.concat(F.lit("s"), F.col("c_custkey")).alias("strategy_id"), F.col("c_acctbal").alias("period_sharpe"), (F.col("c_acctbal") / 2).alias("in_sample_period_sharpe"), (F.col("c_acctbal") - 100).alias("out_sample_period_sharpe"), F.col("c_acctbal").alias("sortino"), F.col("c_nationkey").alias("rolling_window"), F.col("c_mktsegment").alias("short_threshold"))


def mode_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the top of a ranking."""
    return rounded(views.mode(customers_as_results(spark, sf_dir), "is_oos"))


def mode_sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mode(customers_as_results(spark, sf_dir), "sortino")


def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_signal(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "available_ts").cast("timestamp_ntz"))
    own = own.withColumn("signal", F.when(F.col("signal_value") > 150, None).otherwise(F.col("signal_value")))
    own = own.withColumn("event_ts", F.when(F.minute("event_ts") < 5, F.col("available_ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("event_ts")))
    return quality.validate_signal(own, event_ts_col="event_ts", available_ts_col="available_ts", duplicate_policy="warn", stale_after="-30min").drop("message")


def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.downsampled(bars(spark, sf_dir).select("symbol", "ts", "close"), SERIES, 100)


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(views.heat_map(own, "year", "o_orderstatus", "o_totalprice"))


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the top of a ranking: 20 customers by balance, of two market segments."""
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey")).alias("strategy_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("sharpe"), F.col("c_nationkey").cast("double").alias("return_pct"))
    return views.top(views.filtered(own, {"segment": ["BUILDING", "MACHINERY"], "unknown": [1], "return_pct": []}))


def lines_as_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of a strategy for each flag and status, in order of their keys."""
    own = table(spark, sf_dir, "lineitem")
    numbers = {"bars_held": "l_quantity", "pnl_pct": "l_discount", "allocated_capital": "l_extendedprice", "units": "l_quantity", "account_return_pct": "l_tax"}
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("exit_idx")
    return own.select(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("strategy_id"), place, F.col("l_orderkey").alias("entry_idx"), *(F.col(v).cast("double").alias(k) for k, v in numbers.items()))


def last_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the last 500 trades of each strategy."""
    return views.last_trades(lines_as_trades(spark, sf_dir))


def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.trade_summary(lines_as_trades(spark, sf_dir)))


def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filter_options(customers_as_results(spark, sf_dir), ["rolling_window", "short_threshold", "strategy_id"])


def top_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the 50 best strategies of a ranking."""
    own = customers_as_results(spark, sf_dir).withColumnsRenamed({"period_sharpe": "sharpe", "rolling_window": "return_pct"})
    return views.top(own, 50).select("strategy_id", "sharpe", "return_pct")


def objective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the best of a ranking by an objective, 25 of them."""
    own = customers_as_results(spark, sf_dir).withColumns({"net_profit": -F.col("sortino"), "return_pct": F.col("sortino"), "sharpe": F.lit(0.0)})
    return research.rank(own, "net_profit").limit(25).select("strategy_id", "net_profit")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of an account each, its orders as bars and as trades, read back."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey")).alias("strategy_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", "o_totalprice")
    totals = orders.groupBy("strategy_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    out = sinks.payload(totals, orders, orders.select("strategy_id", "o_orderkey", "o_totalprice"), ["strategy_id"])
    fields = {"n": "$.metrics.n", "last": "$.metrics.last", "first_ts": "$.bars[0].ts", "first_key": "$.trades[0].o_orderkey"}
    sizes = {"n_bars": "$.bars", "n_trades": "$.trades"}
    return out.select("strategy_id", *(F.get_json_object("payload", p).alias(k) for k, p in fields.items()), *(F.json_array_length(F.get_json_object("payload", p)).alias(k) for k, p in sizes.items()))


def research_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.research_report(customers_as_results(spark, sf_dir), ["strategy_id"])
    return out.select("strategy_id", *(F.get_json_object("report", f"$.{c}").alias(c) for c in ("short_threshold", "rolling_window")), F.get_json_object("report", "$.sortino").cast("double").alias("sortino"))


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars without two of their columns, and signals without their value."""
    own = bars(spark, sf_dir)
    found = quality.validate_ohlc(own.drop("low", "close")).withColumn("table", F.lit("ohlc"))
    return found.unionByName(quality.validate_signal(own.drop("signal")).withColumn("table", F.lit("signal"))).drop("message")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform and a condition of the user's own, reached by their names."""

    @register_transform("rank_of_two", lookback=lambda: 1)
    def rank_of_two(df: DataFrame, column: str, series: Series) -> DataFrame:
        return df.withColumn(column, F.greatest(F.col(column), F.lag(column).over(series.ordered())))

    @dataclass(frozen=True)
    class Even(Condition):
        lookback = 0

        def column(self, signal: Column, series: Series) -> Column:
            return F.floor(signal) % 2 == 0

    register_condition("even", Even)
    own = apply_transform(bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("x")), "rank_of_two", "x", SERIES)
    return rounded(own.select("symbol", "ts", "x", mask(cond.even(), F.col("x"), SERIES).alias("hit")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest metrics of each event series."""
    return backtest_metrics(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s_ohlc_load": ohlc_load,
    "s_signal_load": signal_load,
    "w_zscore": transform_query("zscore", window=20),
    "w_zscore_ddof": transform_query("zscore", window=12, min_periods=4, ddof=1),
    "w_minmax": transform_query("minmax"),
    "w_minmax_rolling": transform_query("minmax", window=24),
    "w_robust_zscore": transform_query("robust_zscore", window=11),
    "w_pct_change": transform_query("pct_change", periods=2),
    "w_sma": transform_query("sma", window=24),
    "w_ema": transform_query("ema", span=20),
    "w_zscore_long": transform_query("zscore", LONG, window=20),
    "w_minmax_long": transform_query("minmax", LONG),
    "w_robust_zscore_long": transform_query("robust_zscore", LONG, window=11),
    "w_pct_change_long": transform_query("pct_change", LONG, periods=2),
    "w_sma_long": transform_query("sma", LONG, window=24),
    "w_ema_long": transform_query("ema", LONG, span=20),
    "w_identity": transform_query("identity"),
    "w_composed": composed,
    "w_sliced": sliced,
    "p_conditions": conditions,
    "p_custom": custom_condition,
    "j_asof_backward": asof_query("backward"),
    "j_asof_forward": asof_query("forward"),
    "j_asof_nearest": asof_query("nearest"),
    "j_asof_backward_buckets": asof_query("backward", False),
    "j_asof_forward_buckets": asof_query("forward", False),
    "j_asof_nearest_buckets": asof_query("nearest", False),
    "j_asof_keyed": asof_keyed,
    "j_full_outer": full_outer,
    "a_period_metrics": period_metrics,
    "a_drawdown": drawdown,
    "a_period_metrics_long": period_metrics_long,
    "a_drawdown_long": drawdown_long,
    "a_trade_metrics": trade_metrics,
    "d_backtest_trades": backtest_trades,
    "d_backtest_equity": backtest_equity,
    "d_backtest_trades_long": backtest_trades_long,
    "d_backtest_equity_long": backtest_equity_long,
    "d_backtest_metrics": backtest_metrics,
    "d_sweep_rank": sweep_rank,
    "d_research_split": research_split,
    "d_walkforward_folds": walk_forward,
    "d_walkforward_combined": walk_forward_combined,
    "d_stability": stability,
    "d_portfolio_equity": portfolio_equity,
    "d_portfolio_positions": portfolio_positions,
    "d_portfolio_attribution": portfolio_attribution,
    "d_portfolio_metrics": portfolio_metrics,
    "d_portfolio_closed_form": portfolio_closed_form,
    "d_oms_ratios": oms_ratios,
    "d_oms_execution": oms_execution,
    "d_oms_venues": oms_venues,
    "d_oms_exposure": oms_exposure,
    "d_oms_drift": oms_drift,
    "d_oms_risk": oms_risk,
    "d_live_ratios": live_ratios,
    "d_live_slippage": live_venues,
    "d_mc_bootstrap": monte_carlo("bootstrap"),
    "d_mc_shuffle": monte_carlo("shuffle"),
    "v_ohlc": ohlc_quality,
    "v_ohlc_unreadable": ohlc_unreadable,
    "v_signal": signal_quality,
    "v_signal_unreadable": signal_unreadable,
    "o_downsample": downsampled,
    "o_heat_map": heat_map,
    "o_detail_payload": detail,
    "o_portfolio_payload": folio_detail,
    "o_mode_is_oos": mode_in_out,
    "o_mode_sortino": mode_sortino,
    "o_top_rows": top_rows,
    "o_last_trades": last_trades,
    "o_trade_summary": trade_summary,
    "o_filter_options": filter_options,
    "o_top_curves": top_curves,
    "o_objective_rank": objective_rank,
    "o_payload": payloads,
    "o_research_report": research_reports,
    "v_missing_columns": missing_columns,
    "w_registered": registered,
}

ORACLES: dict[str, str] = PLAIN_ORACLES | PLAN_ORACLES
#: The same rows, by blocks of series or buckets of time.
ORACLES |= {name: ORACLES[name.removesuffix(way)] for name in QUERIES for way in ("_long", "_buckets") if name.endswith(way)}

__all__ = ["ORACLES", "QUERIES", "Result", "flagship"]
