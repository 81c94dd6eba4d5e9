"""Read queries over results: filters, rankings, heat maps, filter options and down-sampled curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.series import Series
from ..operators.backtest import trade_report
from ..sources.sinks import iso, shown

#: Limits of curves, points of overview and detail curves, rows of top tables, trades in a detail view.
TOP_CURVES, CURVE_POINTS, DETAIL_POINTS, TOP_ROWS, LAST_TRADES = 50, 1200, 1800, 20, 500


def filtered(table: DataFrame, wanted: dict[str, Sequence[object]]) -> DataFrame:
    """Rows whose columns hold one of the wanted values, compared as text; unknown columns and empty lists don't filter."""
    for column, values in wanted.items():
        if column in table.columns and values:
            table = table.where(F.col(column).cast("string").isin([str(v) for v in values]))
    return table


def ordered(table: DataFrame, sort_by: str = "sharpe") -> DataFrame:
    """By a numeric column, falling, then the return; ``max_drawdown_asc`` by small drawdown; else by Sharpe ratio."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    if sort_by == "max_drawdown_asc" and "max_drawdown" in kinds:
        return table.orderBy(F.asc("max_drawdown"), F.desc("sharpe"), "strategy_id")
    by = sort_by if kinds.get(sort_by) in ("double", "float", "bigint", "int") else "sharpe"
    return table.orderBy(F.desc(by), F.desc("return_pct"), "strategy_id")


def top(table: DataFrame, n: int = TOP_ROWS, sort_by: str = "sharpe") -> DataFrame:
    return ordered(table, sort_by).limit(n)


def heat_map(table: DataFrame, x: str, y: str, metric: str = "sharpe") -> DataFrame:
    """``x, y, value``: the best metric of each pair of parameters."""
    return table.groupBy(x, y).agg(F.max(metric).alias("value"))


def filter_options(table: DataFrame, params: Sequence[str]) -> DataFrame:
    """``param, value``: distinct values of each parameter, as text."""
    pairs = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params))
    return table.select(F.inline(pairs)).distinct()


def downsampled(curve: DataFrame, series: Series, max_points: int = CURVE_POINTS) -> DataFrame:
    """At most ``max_points`` rows of each series, evenly spaced by row number, first and last among them."""
    rows = curve.withColumns({"__k": F.row_number().over(series.ordered()) - 1, "__n": F.count("*").over(series.whole())})
    k, n, m = F.col("__k"), F.col("__n"), max_points
    # row k is chosen if some i has floor(i (n - 1) / (m - 1)) = k
    i = F.ceil(k * (m - 1) / F.greatest(n - 1, F.lit(1)))
    chosen = (F.floor(i * (n - 1) / max(m - 1, 1)) == k) & (i <= m - 1)
    return rows.where((n <= m) | (chosen if m > 1 else k == 0)).drop("__k", "__n")


def last_trades(trades: DataFrame, keys: Sequence[str] = ("symbol", "strategy_id"), n: int = LAST_TRADES) -> DataFrame:
    """The last ``n`` trades of each strategy."""
    newest = Series(tuple(keys), "exit_idx").whole().orderBy(F.desc("exit_idx"), F.desc("entry_idx"))
    return trades.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= n).drop("__k")


def trade_summary(trades: DataFrame, keys: Sequence[str] = ("symbol", "strategy_id")) -> DataFrame:
    """Counts, averages and extremes of each strategy's trades."""
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg("bars_held").alias("avg_bars_held"),
        F.max("pnl_pct").alias("max_pnl_pct"),
        F.min("pnl_pct").alias("min_pnl_pct"),
        F.avg("allocated_capital").alias("avg_allocated_capital"),
        F.avg("units").alias("avg_units"),
        F.avg("account_return_pct").alias("avg_account_return_pct"),
    )


def chart_points(result: DataFrame, series: Series, max_points: int = DETAIL_POINTS) -> DataFrame:
    """Down-sampled bars of each strategy with equity, benchmark and position."""
    keyed = Series((*series.keys, "strategy_id"), series.ts)
    return downsampled(result.select(*keyed.keys, series.ts, "close", "signal", "equity", "benchmark_equity", "position"), keyed, max_points)


def trade_marks(trades: DataFrame, keys: Sequence[str] = ("symbol", "strategy_id")) -> DataFrame:
    """``ts, price, side, mark``: entries and exits of each trade."""
    marks = F.array(*(F.struct(F.col(f"{m}_ts").alias("ts"), F.col(f"{m}_price").alias("price"), "side", F.lit(m).alias("mark")) for m in ("entry", "exit")))
    return trades.select(*keys, F.inline(marks))


#: Parameters that charts draw as level lines.
LEVELS = {"long_threshold": "long_threshold", "short_threshold": "short_threshold", "exit_signal": "exit_threshold"}
_AS_IS = {"ignoreNullFields": "false"}
_MARKS = "array<struct<exit_idx:bigint,entry_idx:bigint,side:string,entry_at:string,entry_price:double,exit_at:string,exit_price:double>>"


def detail_payload(rows: DataFrame, trades: DataFrame, metrics: DataFrame, series: Series = Series(), params: DataFrame | None = None, max_points: int = DETAIL_POINTS, benchmark_name: str = "Benchmark") -> DataFrame:
    """Keys and ``payload``: JSON of all that a detail view of a strategy shows.

    Parameters, metrics, the usable range, the last trades, a summary of all trades, and chart data: equity
    and benchmark, price and signal, entries and exits, and a line for each level among the parameters.
    ``params`` has ``strategy_id`` and a column each parameter. A chart holds at most ``max_points`` points.
    """
    keys = [*series.keys, "strategy_id"]
    points = shown(chart_points(rows, series, max_points)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(series.ts, "close", "signal", "equity", "benchmark_equity"))).alias("points"))
    dealt = trades.withColumns({f"{m}_at": iso(F.col(f"{m}_ts")) for m in ("entry", "exit")})
    marks = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("exit_idx", "entry_idx", "side", "entry_at", "entry_price", "exit_at", "exit_price"))).alias("marks"))
    last = last_trades(trades, keys)
    report = [c for c in trade_report(last).columns if c not in keys]
    last = trade_report(last.withColumn("__k", F.struct("exit_idx", "entry_idx"))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", F.struct(*report).alias("trade")))).alias("last"))
    summary = trade_summary(trades, keys).select(*keys, F.struct(*(c for c in trade_summary(trades, keys).columns if c not in keys)).alias("debug_summary"))
    whole = shown(metrics)
    own = whole.select(*keys, *(c for c in ("usable_start", "usable_end", "usable_rows") if c in whole.columns), F.struct(*(c for c in whole.columns if c not in keys)).alias("metrics"))
    for more in (points, marks, last, summary):
        own = own.join(more, keys, "left")
    named = [c for c in params.columns if c != "strategy_id"] if params is not None else []
    if named:
        own = own.join(params.select("strategy_id", F.struct(*named).alias("params")), "strategy_id", "left")
    p, m = F.col("points"), F.coalesce("marks", F.array().cast(_MARKS))

    def side(name: str) -> Column:
        return F.filter(m, lambda x: x["side"] == name)

    ends = F.when(F.size(p) > 0, F.array(p[0][series.ts], F.element_at(p, -1)[series.ts]))
    lines = []
    for name, line in LEVELS.items():
        level = F.col(f"params.{name}").cast("double") if name in named else F.lit(None).cast("double")
        lines += [ends.alias(f"{line}_dates"), F.when(level.isNotNull(), F.array(level, level)).otherwise(F.array().cast("array<double>")).alias(line)]
    equity = F.struct(p[series.ts].alias("strategy_dates"), p["equity"].alias("strategy_equity"), p[series.ts].alias("benchmark_dates"), p["benchmark_equity"].alias("benchmark_equity"))
    entries = [x for s in ("long", "short") for x in (side(s.upper())["entry_at"].alias(f"entry_{s}_dates"), side(s.upper())["entry_price"].alias(f"entry_{s}_prices"))]
    price = F.struct(p[series.ts].alias("dates"), p["close"].alias("close"), p["signal"].alias("signal"), *lines, *entries, m["exit_at"].alias("exit_dates"), m["exit_price"].alias("exit_prices"))
    charts = F.struct(equity.alias("equity_chart"), price.alias("price_signal_chart"))
    fields = [F.col("strategy_id").alias("name"), *keys, *(["params"] if named else []), "metrics", *(c for c in ("usable_start", "usable_end", "usable_rows") if c in whole.columns), F.col("last.trade").alias("trades"), "debug_summary", charts.alias("chart_data"), F.struct(F.lit(benchmark_name).alias("name"), F.create_map().cast("map<string,string>").alias("metrics")).alias("benchmark")]
    return own.select(*keys, F.to_json(F.struct(*fields), _AS_IS).alias("payload"))


def portfolio_payload(name: str, metrics: DataFrame, equity: DataFrame, positions: DataFrame, attribution: DataFrame) -> DataFrame:
    """One row, ``payload``: JSON of a portfolio's metrics, equity and positions in order of time, and profit and fees by symbol."""

    def listed(df: DataFrame, alias: str, *first: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*first, *(c for c in df.columns if c not in first)))).alias(alias))

    by = [F.map_from_entries(F.collect_list(F.struct("symbol", c))).alias(f"{c}_by_symbol") for c in ("pnl", "fee")]
    own = shown(metrics).select(F.struct(*metrics.columns).alias("metrics"))
    for more in (listed(shown(equity), "equity", "ts"), listed(shown(positions), "positions", "ts", "symbol"), attribution.agg(*by).select(F.struct("pnl_by_symbol", "fee_by_symbol").alias("attribution"))):
        own = own.crossJoin(more)  # one row each
    return own.select(F.to_json(F.struct(F.lit(name).alias("name"), "metrics", "equity", "positions", "attribution"), _AS_IS).alias("payload"))


#: The metric that each view of a sweep shows.
MODES = {"trade_sharpe": "trade_sharpe", "period_sharpe": "period_sharpe", "sortino": "sortino", "calmar": "calmar", "max_drawdown": "max_drawdown", "stability": "validation_is_oos_consistency_score", "sharpe": "sharpe"}


def mode(table: DataFrame, key: str, x: str = "short_threshold", y: str = "rolling_window", n: int = TOP_ROWS) -> DataFrame:
    """What a view of a sweep's results shows.

    ``is_oos``: in-sample and out-of-sample ratios of the ``n`` best strategies by ``period_sharpe``. Any
    other view is a heat map of its metric over two parameters, or, without these columns, its ``n`` best.
    """
    if key == "is_oos":
        return table.orderBy(F.desc("period_sharpe"), "strategy_id").limit(n).select("strategy_id", "in_sample_period_sharpe", "out_sample_period_sharpe")
    metric = MODES[key]
    if x in table.columns and y in table.columns:
        return heat_map(table, x, y, metric)
    return table.orderBy(F.desc(metric), "strategy_id").limit(n).select("strategy_id", F.col(metric).alias("value"))
