"""Semantics of the engine on small inputs: as-of joins, the position rules, metrics, plans and views."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.functions import blocks
from quantloom.functions.conditions import CONDITIONS, Condition, cond, register_condition
from quantloom.functions.series import Series, exact_quantile
from quantloom.functions.transforms import TRANSFORMS, apply_transform, norm, register_transform
from quantloom.operators import align, metrics, montecarlo, oms, portfolio, quality
from quantloom.operators.backtest import Risk, Strategy, simulate, trade_report, trades_of
from quantloom.plans import research, views
from quantloom.plans.strategy import new, sweep
from quantloom.sources import market, sinks

DAY = timedelta(days=1)


def day(n: int, start: str = "2024-01-01") -> datetime:
    return datetime.fromisoformat(start) + n * DAY


def series_of(spark, values, start="2024-01-01", **more):
    rows = [("a", day(k, start), None if v is None else float(v), *(float(c[k]) for c in more.values())) for k, v in enumerate(values)]
    names = ["symbol string", "ts timestamp_ntz", "close double", *(f"{n} double" for n in more)]
    return spark.createDataFrame(rows, ", ".join(names))


# --- as-of


def test_availability_prevents_look_ahead(spark):
    bars = series_of(spark, [100, 101], start="2024-01-02")
    signals = spark.createDataFrame([(day(0), day(0), 1.0), (day(1), day(2), 99.0)], "event_ts timestamp_ntz, available_ts timestamp_ntz, signal_value double")
    rows = align.align_signal_to_bars(bars, signals, tolerance="7D").orderBy("ts").collect()
    assert rows[0]["signal"] == 1.0 and rows[0]["lookahead_safe"] and rows[0]["signal_available_ts"] <= rows[0]["ts"] and rows[1]["signal"] == 99.0


def test_lag_blocks_a_signal_of_the_same_time(spark):
    bars = series_of(spark, [100], start="2024-01-02")
    signal = spark.createDataFrame([(day(1), day(1), 5.0)], "event_ts timestamp_ntz, available_ts timestamp_ntz, signal_value double")
    row = align.align_signal_to_bars(bars, signal, min_lag="1s").first()
    assert row["signal"] is None and not row["lookahead_safe"]
    empty = align.align_signal_to_bars(bars, signal.where("1 = 0")).first()
    assert empty["signal"] is None and empty["alignment_method"] == "merge_asof_backward_available_ts"
    with pytest.raises(ValueError, match="direction"):
        align.align_signal_to_bars(bars, signal, direction="up")
    with pytest.raises(ValueError, match="stale_policy"):
        align.align_signal_to_bars(bars, signal, stale_policy="no")


@pytest.mark.parametrize("broadcast", [False, True])
@pytest.mark.parametrize("direction", align.DIRECTIONS)
def test_asof_matches_pandas(spark, direction, broadcast):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 900_000, 300)), "s")})
    right = pd.DataFrame({"rts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(900_000, 120, False)), "s"), "v": np.arange(120.0)})
    want = pd.merge_asof(left, right, left_on="ts", right_on="rts", direction=direction)["v"]
    got = align.asof(spark.createDataFrame(left), spark.createDataFrame(right), on=align.time_of("ts"), right_on=align.time_of("rts"), columns={"v": F.col("v")}, direction=direction, broadcast=broadcast)
    assert broadcast == ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString())
    got = got.select("ts", F.col("match.v").alias("v")).toPandas().sort_values(["ts", "v"])["v"]
    assert sorted(got.fillna(-1)) == sorted(want.fillna(-1))


@pytest.mark.parametrize("direction", align.DIRECTIONS)
def test_asof_by_keys_is_the_same_broadcast_and_in_buckets(spark, monkeypatch, direction):
    rng = np.random.default_rng(4)
    draw = lambda n: [(rng.choice(["a", "b", None, "c"]), int(rng.integers(0, 3)), None if rng.random() < 0.05 else int(rng.integers(0, 60)) * 10**10, float(k)) for k in range(n)]
    left = spark.createDataFrame(draw(500), "k string, j int, t long, x double")
    right = spark.createDataFrame([(k or "d" if r % 7 else k, j, t, None if r % 11 == 0 else x) for r, (k, j, t, x) in enumerate(draw(300))], "k string, j int, u long, v double")

    def rows(**how):
        out = align.asof(left, right, on=F.col("t"), right_on=F.col("u"), columns={"v": F.col("v"), "w": F.col("u") + 1}, by=["k", "j"], direction=direction, **how)
        return {r["x"]: None if r["match"] is None else (r["match"]["at"], r["match"]["v"], r["match"]["w"]) for r in out.collect()}

    want = rows(broadcast=False)
    assert rows(broadcast=True) == want == rows() and sum(v is not None for v in want.values()) > 200
    monkeypatch.setattr(align, "BROADCAST_ROWS", 100)  # too many rows for it
    assert rows(broadcast=True) == want
    none = align.asof(left, right.where("1 = 0"), on=F.col("t"), right_on=F.col("u"), columns={"v": F.col("v")}, by=["k"], direction=direction, broadcast=True)
    assert none.count() == 500 and none.where("match IS NOT NULL").count() == 0


@pytest.mark.parametrize("direction", align.DIRECTIONS)
def test_a_full_bucket_is_read_once(spark, direction):
    # 30,000 rows of one day; a frame that reaches to a bucket's end is computed anew for every row of it
    left = spark.range(15_000).select((F.col("id") * 5_000_011 % 86_400_000_000).alias("t"), "id")
    right = spark.range(15_000).select((F.col("id") * 7_000_003 % 86_400_000_000).alias("u"), F.col("id").alias("v"))
    found = {b: align.asof(left, right, on=F.col("t"), right_on=F.col("u"), columns={"v": F.col("v")}, direction=direction, broadcast=b) for b in (False, True)}
    assert "unboundedfollowing" not in found[False]._jdf.queryExecution().executedPlan().toString().lower()
    rows = {b: sorted((r["id"], r["match"] and tuple(r["match"])) for r in own.collect()) for b, own in found.items()}
    assert rows[False] == rows[True] and len(rows[True]) == 15_000


def test_stale_policies_and_null_times(spark):
    bars = spark.createDataFrame([(day(5),), (None,)], "ts timestamp_ntz")
    signal = spark.createDataFrame([(day(0), 5.0)], "event_ts timestamp_ntz, signal_value double")
    with pytest.warns(RuntimeWarning):
        found = {p: align.align_signal_to_bars(bars, signal, stale_policy=p).collect() for p in align.STALE_POLICIES}
    assert [len(found[p]) for p in ("nan", "drop", "keep")] == [2, 1, 2]
    kept = next(r for r in found["keep"] if r["ts"])
    assert kept["signal"] == 5.0 and kept["is_stale_signal"] and next(r for r in found["nan"] if r["ts"])["signal"] is None


# --- transforms


def test_transforms_match_pandas(spark):
    rng = np.random.default_rng(5)
    x = pd.Series(rng.normal(size=60)).mask(rng.random(60) < 0.1)
    df = series_of(spark, [None if np.isnan(v) else v for v in x])

    def run(name, **options):
        return apply_transform(df, name, "close", Series(), **options).orderBy("ts").toPandas()["close"]

    for adjust in (False, True):
        np.testing.assert_allclose(run("ema", span=5, adjust=adjust), x.ewm(span=5, adjust=adjust).mean(), equal_nan=True)
    r = x.rolling(8, min_periods=4)
    np.testing.assert_allclose(run("zscore", window=8, min_periods=4), (x - r.mean()) / r.std(ddof=0), equal_nan=True, atol=1e-9)
    np.testing.assert_allclose(run("sma", window=3), x.rolling(3).mean(), equal_nan=True)
    np.testing.assert_allclose(run("pct_change"), x.ffill().pct_change(), equal_nan=True)
    for name, options in (("robust_zscore", {"window": 3}), ("robust_zscore", {"window": 1})):
        med = x.rolling(options["window"]).median()
        np.testing.assert_allclose(run(name, **options), (0.6745 * (x - med) / (x - med).abs().rolling(options["window"]).median().replace(0, np.nan)), equal_nan=True)
    med = x.rolling(3).median()
    np.testing.assert_allclose(run("robust_zscore", window=3), (0.6745 * (x - med) / (x - med).abs().rolling(3).median().replace(0, np.nan)), equal_nan=True)
    with pytest.raises(KeyError):
        run("unknown")


@pytest.mark.parametrize("adjust", [False, True])
def test_ema_over_small_batches(spark, adjust):
    rng = np.random.default_rng(6)
    x = pd.Series(rng.normal(size=50)).mask(rng.random(50) < 0.3)
    x[:3], x[20:32] = np.nan, np.nan
    df = series_of(spark, [None if np.isnan(v) else v for v in x])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for span in (1, 5, 30):
            got = apply_transform(df, "ema", "close", Series(), span=span, adjust=adjust).orderBy("ts").toPandas()["close"]
            np.testing.assert_allclose(got, x.ewm(span=span, adjust=adjust).mean(), equal_nan=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_registries(spark):
    register_transform("double")(lambda df, column, series: df.withColumn(column, 2 * F.col(column)))

    class Odd(Condition):
        def column(self, signal, series):
            return signal % 2 == 1

    register_condition("odd", Odd)
    try:
        rows = new(series_of(spark, [1, 2, 3, 4], signal=[0.5, 1, 1.5, 2])).norm(norm.double()).entry(long=cond.odd()).run().trades.collect()
        assert [r["entry_idx"] for r in rows] == [0]
    finally:
        del TRANSFORMS["double"], CONDITIONS["odd"]


@pytest.mark.parametrize("batch", [10_000, 3])
def test_custom_conditions_look_back_over_batches(spark, batch):
    values = [1, 2, 3, 2, 3, 4, 5, 1, 2, 3]
    df = series_of(spark, values)
    want = [k > 1 and values[k] > values[k - 1] > values[k - 2] for k in range(len(values))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for own in (cond.each(lambda x, k: k > 1 and x[k] > x[k - 1] > x[k - 2], 2), cond.custom(queries._two_rises, 2)):
            assert [r["close"] for r in own.added(df, "close", Series()).where(own.column(F.col("close"), Series())).orderBy("ts").collect()] == [float(v) for v, w in zip(values, want) if w]
            result = new(df.withColumn("signal", F.col("close"))).entry(long=own).run()
            assert result.trades.first()["entry_idx"] == 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=501), np.repeat(rng.normal(size=3), [1, 400, 7])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert exact_quantile(df, q).first()["value"] == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert exact_quantile(df.where("1 = 0"), q).first()["value"] is None


# --- position rules


def reference_fold(bars, s):
    """The rules bar by bar, in plain Python."""
    r, cash, pos, trades, equity = s.risk, 100.0, 0, [], []
    for k, b in enumerate(bars):
        exited = False
        if pos:
            stop = None if r.stop_loss_pct is None else price * (1 + pos * r.stop_loss_pct / 100)
            take = None if r.take_profit_pct is None else price * (1 + pos * r.take_profit_pct / 100)
            bad, good = (b["low"], b["high"]) if pos > 0 else (b["high"], b["low"])
            why = out = None
            if stop is not None and (bad <= stop if pos > 0 else bad >= stop):
                why, out = "stop_loss", stop
            elif take is not None and (good >= take if pos > 0 else good <= take):
                why, out = "take_profit", take
            elif b["lx" if pos > 0 else "sx"]:
                why, out = "signal_exit", b["close"]
            if why:
                pnl = units * (out - price) * pos - alloc * r.fee_pct - alloc * r.slippage_pct
                trades.append((at, k, pos, why, round(pnl, 9)))
                cash, pos, exited = cash + pnl, 0, True
        if not pos and (not exited or r.allow_same_bar_reentry) and (b["le"] or b["se"]):
            pos, price, at = (1 if b["le"] else -1), b["close"], k
            alloc = cash * r.position_size_pct
            units = alloc / price if price > 0 else 0
            cash -= alloc * r.fee_pct + alloc * r.slippage_pct
        equity.append(cash + (units * (b["close"] - price) * pos if pos and price > 0 else 0))
    if pos:
        pnl = units * (b["close"] - price) * pos - alloc * r.fee_pct - alloc * r.slippage_pct
        trades.append((at, k, pos, "forced_end", round(pnl, 9)))
        equity[-1] = cash + pnl
    return trades, equity


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("batch", [10_000, 7])
def test_fold_matches_the_rules_bar_by_bar(spark, seed, batch):
    rng = np.random.default_rng(seed)
    n = 300
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    high, low, sig = close * (1 + rng.random(n) * 0.05), close * (1 - rng.random(n) * 0.05), rng.normal(size=n)
    bars = series_of(spark, close, high=high, low=low, signal=sig)
    strategies = []
    for k, (take, stop, again) in enumerate([(None, None, False), (3.0, -2.0, False), (3.0, -2.0, True), (None, -4.0, True)]):
        risk = Risk(0.5, 0.001, 0.0005, take, stop, again)
        strategies.append(Strategy(f"s{k}", (), cond.above(1.0), cond.below(-1.0), cond.cross_below(0.2), cond.cross_above(-0.2), risk))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = simulate(bars, strategies).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    prev = np.concatenate(([np.nan], sig[:-1]))
    first = np.isnan(prev)
    lx, sx = (sig <= 0.2) & (first | (prev > 0.2)), (sig >= -0.2) & (first | (prev < -0.2))
    plain = [dict(close=close[k], high=high[k], low=low[k], le=sig[k] >= 1, se=sig[k] <= -1, lx=lx[k], sx=sx[k]) for k in range(n)]
    for s in strategies:
        trades, equity = reference_fold(plain, s)
        own = rows[rows.strategy_id == s.strategy_id].sort_values("idx")
        np.testing.assert_allclose(own.equity, equity, rtol=1e-9)
        got = [(t["entry_idx"], t["exit_idx"], 1 if t["side"] == "LONG" else -1, t["exit_reason"], t["pnl_cash"]) for cell in own.trades if cell is not None for t in cell]
        assert [t[:4] for t in got] == [t[:4] for t in trades]
        np.testing.assert_allclose([t[4] for t in got], [t[4] for t in trades], atol=1e-7)


def test_equity_adds_up_and_sweep_equals_single(spark):
    rng = np.random.default_rng(9)
    bars = series_of(spark, 100 + np.cumsum(rng.normal(size=200)), signal=rng.normal(size=200))

    def build(base, level):
        return base.entry(long=cond.above(level)).exit(long=cond.below(-level)).risk(fee_pct=0.002, position_size_pct=0.3)

    plan = sweep(new(bars), level=[0.5, 1.0]).builder(build)
    table = {r["level"]: r for r in plan.table().collect()}
    for level in (0.5, 1.0):
        single = build(new(bars), level).run()
        trades = single.trades.collect()
        end = single.equity.orderBy(F.desc("idx")).first()["equity"]
        assert abs(end - (100 + sum(t["pnl_cash"] - t["fee_cash"] / 2 for t in trades))) < 1e-9
        own = single.metrics().first()
        assert abs(own["sharpe"] - table[level]["sharpe"]) < 1e-9 and own["sharpe"] == own["trade_sharpe"] and own["num_trades"] == len(trades)
    assert simulate(bars.where("1 = 0"), plan.strategies()).count() == 0
    with pytest.raises(ValueError, match="builder"):
        sweep(new(bars), level=[1]).strategies()


def test_flow_of_the_smallest_example(spark):
    bars = series_of(spark, range(101, 126), start="2023-01-01", signal=[-1] * 5 + [1] * 10 + [-1] * 10)
    result = new(bars).norm("zscore", window=3).entry(long=cond.cross_above(0.0)).exit(long=cond.cross_below(0.0)).risk(position_size_pct=0.1, fee_pct=0.00055).run()
    text = sinks.payload(result.metrics(), views.chart_points(result.rows, Series(), 10), views.last_trades(result.trades)).first()["payload"]
    assert len(json.loads(text)["bars"]) == 4 and trade_report(result.trades).first()["entry_date"].startswith("2023-")
    assert json.loads(sinks.research_report(result.metrics()).first()["report"])["symbol"] == "a"


def test_detail_payload(spark):
    bars = series_of(spark, range(101, 126), start="2023-01-01", signal=[-1] * 5 + [1] * 10 + [-1] * 10)
    result = new(bars).entry(long=cond.cross_above(0.0), short=cond.cross_below(0.0)).exit(long=cond.cross_below(0.0), short=cond.cross_above(0.0)).params(long_threshold=0.0).run().stored()
    levels = result.metrics().select("strategy_id", F.lit(0.0).alias("long_threshold"))
    own = json.loads(views.detail_payload(result.rows, result.trades, result.metrics(), Series(), levels, 10).first()["payload"])
    chart = own["chart_data"]["price_signal_chart"]
    trades = result.trades.orderBy("exit_idx").collect()
    assert own["usable_rows"] == 25 and len(chart["dates"]) == len(own["chart_data"]["equity_chart"]["strategy_equity"]) == 10
    assert chart["long_threshold"] == [0.0, 0.0] and chart["long_threshold_dates"] == ["2023-01-01T00:00:00", "2023-01-25T00:00:00"] and chart["exit_threshold"] == []
    assert chart["exit_prices"] == [t["exit_price"] for t in trades] and len(chart["entry_long_dates"]) == sum(t["side"] == "LONG" for t in trades)
    assert [t["exit_reason"] for t in own["trades"]] == [t["exit_reason"] for t in trades] and own["debug_summary"]["trades"] == len(trades) and own["params"] == {"long_threshold": 0.0}
    none = new(bars).run().stored()
    assert json.loads(views.detail_payload(none.rows, none.trades, none.metrics()).first()["payload"])["trades"] is None


def test_results_are_simulated_once(spark):
    bars = series_of(spark, range(101, 126), start="2023-01-01", signal=[-1] * 5 + [1] * 10 + [-1] * 10)
    plan = sweep(new(bars), level=[0.0, 0.5]).builder(lambda base, level: base.entry(long=cond.cross_above(level)).exit(long=cond.cross_below(-level)))
    walked = research.walk_forward(plan, train_window="10D", test_window="5D", step="5D")
    for frame in (plan.table(), research.flat_research(plan.run(), research.Protocol()), walked.folds, walked.combined):
        assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()


# --- metrics


def test_drawdown_detail_and_sharpes(spark):
    row = metrics.drawdowns(series_of(spark, [100, 90, 95, 110]).withColumnRenamed("close", "equity"), Series()).first()
    assert (row["max_drawdown_pct"], row["max_drawdown_start"], row["max_drawdown_end"], row["max_drawdown_recovery"], row["max_drawdown_duration_days"]) == (10.0, day(0), day(1), day(3), 3.0)
    curve = series_of(spark, [100, 101, 102, 101, 103]).withColumnRenamed("close", "equity")
    trades = spark.createDataFrame([("a", p, 10 * p, p, 1, day(k), day(k + 1)) for k, p in ((0, 1.0), (2, -0.5), (3, 1.2))], "symbol string, account_return_pct double, pnl_pct double, pnl_cash double, bars_held int, entry_ts timestamp_ntz, exit_ts timestamp_ntz")
    trades = trades.withColumns({c: F.lit(0.0) for c in ("fee_cash", "slippage_cash", "allocated_capital")})
    own = metrics.strategy_metrics(curve, trades, Series()).first()
    assert own["trade_sharpe"] and own["period_sharpe"] and own["trade_sharpe"] != own["period_sharpe"]
    x = np.array([0.01, -0.005, 0.012])
    assert abs(own["trade_sharpe"] - x.mean() / x.std() * np.sqrt(3 / 4 * 365)) < 1e-9


def test_period_metrics_match_pandas(spark):
    e = 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.01, 80)))
    row = metrics.period_metrics(series_of(spark, e).withColumnRenamed("close", "equity"), Series()).first()
    r = pd.Series(e).pct_change().dropna()
    year = np.sqrt(365)
    down = r[r < 0].std(ddof=0)
    want = {"period_sharpe": r.mean() / r.std(ddof=0) * year, "sortino": r.mean() / down * year, "VaR_95": r.quantile(0.05) * 100, "CVaR_95": r[r <= r.quantile(0.05)].mean() * 100, "skew": r.skew(), "kurtosis": r.kurtosis(), "return_pct": (e[-1] / e[0] - 1) * 100}
    want["rolling_sharpe"] = (r.rolling(30).mean() / r.rolling(30).std(ddof=0)).iloc[-1] * year
    want["rolling_sortino"] = (r.rolling(30).mean() / r.where(r < 0, 0).rolling(30).std(ddof=0)).iloc[-1] * year
    for name, value in want.items():
        assert abs(row[name] - value) < 1e-7, name


# --- plans


def split_bars(spark):
    return series_of(spark, np.linspace(100, 130, 30), start="2020-01-01", signal=[-1] * 5 + [1] * 15 + [-1] * 10)


def test_research_split(spark):
    result = new(split_bars(spark)).entry(long=cond.cross_above(0)).exit(long=cond.cross_below(0)).run()
    protocol = research.Protocol(in_sample=("2020-01-01", "2020-01-15"), out_sample=("2020-01-16", "2020-01-30"))
    found = {r["label"]: r for r in research.split_metrics(result, protocol).collect()}
    assert set(found) == {"full", "in_sample", "out_sample"} and found["in_sample"]["usable_rows"] == 15 and found["out_sample"]["num_trades"] == 1
    row = research.flat_research(result, protocol).first()
    assert row["validation_warnings"].startswith("oos_trades_too_few") and not row["validation_oos_pass"]


def test_walk_forward(spark):
    bars = series_of(spark, 100.0 + np.arange(40), start="2021-01-01", signal=np.sin(np.arange(40) / 3))
    plan = new(bars).entry(long=cond.cross_above(0)).exit(long=cond.cross_below(0))
    found = research.walk_forward(plan, train_window="10D", test_window="5D", step="5D")
    rows = found.folds.orderBy("fold").collect()
    assert len(rows) == 6 and all(r["train_end"] <= r["test_start"] for r in rows) and found.combined.count() == 1
    assert found.stability.first()["param_reuse_ratio"] == 1.0
    with pytest.raises(ValueError, match="positive"):
        research.walk_forward(plan, step="0D")


def test_stability_of_a_flat_and_a_peaked_grid(spark):
    rows = [(f"s{k}", k, float(v), float(v), float(w)) for k, (v, w) in enumerate(zip([1, 1, 1, 1, 9], [1, 2, 3, 4, 5]))]
    table = spark.createDataFrame(rows, "strategy_id string, p bigint, sharpe double, in_sample_sharpe double, out_sample_sharpe double")
    row = research.parameter_stability(table, ["p"], "sharpe").first()
    assert abs(row["neighbor_sharpe_decay"] - 8 / 9) < 1e-12 and row["heatmap_smoothness_score"] == 1 / 3 and row["top_decile_consistency"] == 1
    want = pd.Series([1, 1, 1, 1, 9]).rank().corr(pd.Series([1, 2, 3, 4, 5]).rank())
    assert abs(row["is_oos_rank_corr"] - want) < 1e-12 and row["best_params"]["p"] == 4


def test_stability_of_values_equal_but_for_their_last_digits(spark):
    noise = 1e-14
    rows = [("s0", 1, 2.0, 1.0, 5.0), ("s1", 2, 2.0 + noise, 2.0, 5.0 - noise), ("s2", 3, 1.0, 3.0, 4.0 + noise), ("s3", 4, 0.5, 3.0 + noise, 4.0)]
    table = spark.createDataFrame(rows, "strategy_id string, p bigint, sharpe double, in_sample_sharpe double, out_sample_sharpe double")
    row = research.parameter_stability(table, ["p"], "sharpe").first()
    assert row["is_oos_rank_corr"] == pytest.approx(pd.Series([1, 2, 3, 3]).rank().corr(pd.Series([5, 5, 4, 4]).rank()))
    assert row["best_params"]["p"] == 1 and row["best_is_params"]["p"] == 3 and row["best_oos_params"]["p"] == 1


# --- portfolio, OMS, Monte Carlo, quality, sources


def test_portfolio_of_one_symbol(spark):
    prices = series_of(spark, [100, 110])
    signals = prices.limit(2).where(F.col("ts") == F.lit(day(0))).select("ts", "symbol", F.lit("s1").alias("strategy_id"), F.lit(1.0).alias("target_weight"))
    weights = spark.createDataFrame([("s1", 1.0)], "strategy_id string, weight double")
    grid = portfolio.price_grid(prices, portfolio.net_targets(signals, weights))
    equity = portfolio.portfolio_equity(grid, 1000.0)
    assert equity.orderBy(F.desc("ts")).first()["equity"] == pytest.approx(1100)
    assert portfolio.attribution(portfolio.portfolio_positions(grid, equity)).first()["pnl"] == pytest.approx(100)
    assert portfolio.portfolio_metrics(equity).first()["return_pct"] == pytest.approx(10)


def test_portfolios_by_key(spark):
    one = series_of(spark, [100, 110, 99])
    two = series_of(spark, [50, 45]).withColumn("symbol", F.lit("b"))
    prices = one.withColumn("folio", F.lit("x")).union(one.union(two).withColumn("folio", F.lit("y")))
    targets = spark.createDataFrame([("x", day(0), "a", 1.0), ("y", day(0), "a", 0.5), ("y", day(0), "b", 0.5)], "folio string, ts timestamp_ntz, symbol string, target double")
    for fee in (0.0, 0.01):
        grid = portfolio.price_grid(prices, targets, ["folio"])
        equity = portfolio.portfolio_equity(grid, 100.0, fee, ["folio"])
        got = {(r["folio"], r["ts"]): r["equity"] for r in equity.collect()}
        for name, own in (("x", one), ("y", one.union(two))):
            alone = portfolio.portfolio_equity(portfolio.price_grid(own, targets.where(F.col("folio") == name).drop("folio")), 100.0, fee)
            assert {t: e for (f, t), e in got.items() if f == name} == pytest.approx({r["ts"]: r["equity"] for r in alone.collect()})
        positions = portfolio.portfolio_positions(grid, equity, fee, ["folio"])
        gain = positions.groupBy("folio").agg(F.count("*").alias("n")).collect()
        assert {r["folio"]: r["n"] for r in gain} == {"x": 3, "y": 6} and portfolio.portfolio_metrics(equity, keys=["folio"]).count() == 2
        assert portfolio.attribution(positions, ["folio"]).count() == 3
    closed = {(r["folio"], r["ts"]): r["equity"] for r in portfolio.closed_form_equity(portfolio.price_grid(prices, targets, ["folio"]), keys=["folio"]).collect()}
    free = portfolio.portfolio_equity(portfolio.price_grid(prices, targets, ["folio"]), keys=["folio"])
    assert closed == pytest.approx({(r["folio"], r["ts"]): r["equity"] for r in free.collect()})


def test_portfolio_symbol_listed_late(spark):
    prices = series_of(spark, [100, 110, 121]).union(series_of(spark, [None, 50, 55]).withColumn("symbol", F.lit("b"))).dropna()
    targets = spark.createDataFrame([(day(0), s, 0.5) for s in "ab"], "ts timestamp_ntz, symbol string, target double")
    grid = portfolio.price_grid(prices, targets)
    rows = portfolio.portfolio_equity(grid, 100.0).orderBy("ts").collect()
    assert [r["equity"] for r in rows] == pytest.approx([100, 105, 115.5])
    assert {r["symbol"]: r["pnl"] for r in portfolio.attribution(portfolio.portfolio_positions(grid, portfolio.portfolio_equity(grid, 100.0))).collect()} == pytest.approx({"a": 10.25, "b": 5.25})


def test_oms_metrics(spark):
    orders = market.records(spark, [{"status": "Filled"}, {"status": "REJECT"}, {"status": "canceled"}, {"status": "new"}], market.ORDERS)
    fills = market.records(spark, [{"side": "sell", "fill_price": 99.0, "arrival_price": 100.0, "venue": "x", "fee": 1.0}, {"fill_price": 101.0, "arrival_price": 100.0, "venue": "x"}, {"fill_price": 1.0, "arrival_price": 0.0}], market.FILLS)
    places = market.records(spark, [{"ts": day(0), "symbol": "a", "quantity": 5.0, "mark_price": 2.0}, {"ts": day(1), "symbol": "a", "quantity": 4.0, "mark_price": 3.0}], market.POSITIONS)
    targets = market.records(spark, [{"ts": day(0), "symbol": "a", "target_quantity": 4.0}], market.TARGETS)
    row = oms.oms_metrics(orders=orders, fills=fills, positions=places, targets=targets, equity=market.records(spark, None, market.EQUITY)).first()
    assert (row["fill_ratio"], row["cancel_ratio"], row["reject_ratio"]) == (0.25, 0.25, 0.25) and row["average_slippage_bps"] == pytest.approx(100)
    assert row["execution_quality_by_venue"]["x"]["avg_slippage_bps"] == pytest.approx(0) and row["execution_quality_by_venue"]["x"]["fills"] == 2
    assert row["exposure_by_symbol"] == {"a": 12.0} and row["target_vs_actual_position_drift"] == 0.5 and row["OMS_period_sharpe"] == 0


def test_monte_carlo(spark):
    returns = spark.createDataFrame([(k, r) for k, r in enumerate([0.1, -0.05, 0.02, None])], "step bigint, r double")
    paths = montecarlo.simulate_trade_paths(returns, n_sims=5, method="shuffle").toPandas()
    assert paths.groupby("sim").equity.last().round(9).nunique() == 1 and len(paths) == 15
    empty = montecarlo.robustness(returns.where("1 = 0"), n_sims=5).first()
    assert empty["probability_of_loss"] == 0 and empty["terminal_equity_p50"] == 1
    with pytest.raises(ValueError, match="method"):
        montecarlo.simulate_trade_paths(returns, method="x")


def plain_permutation(n, sim, seed):
    """Images of 0 to n - 1, each walked until it is below n."""
    digests = [hashlib.md5(f"{seed}-{sim}-{k}".encode()).hexdigest() for k in range(6)]
    keys = [(int(d[:7], 16), int(d[7:14], 16)) for d in digests]
    width = int(np.ceil(np.sqrt(n)))
    out = []
    for x in range(n):
        while True:
            left, right = divmod(x, width)
            for a, b in keys:
                left, right = right, (left + (right + a) % (2**31 - 1) * ((right + b) % (2**31 - 1)) % (2**31 - 1)) % width
            x = left * width + right
            if x < n:
                break
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 100, 997])
def test_a_shuffle_permutes(spark, n):
    keys = spark.range(12).select(F.col("id").alias("sim"), montecarlo.permutation_keys(F.col("id"), 5).alias("keys"))
    steps = spark.range(12 * n).select((F.col("id") / n).cast("bigint").alias("sim"), (F.col("id") % n).alias("step"))
    rows = montecarlo.permuted(steps.join(keys, "sim"), "step", "keys", n, "at").orderBy("sim", "step").collect()
    found = [[r["at"] for r in rows if r["sim"] == sim] for sim in range(12)]
    assert all(sorted(own) == list(range(n)) for own in found) and found == [plain_permutation(n, sim, 5) for sim in range(12)]
    if n >= 100:  # simulations differ, and steps move as far as in any shuffle
        assert len({tuple(own) for own in found}) == 12
        assert 0.25 < np.mean([abs(a - k) / n for own in found for k, a in enumerate(own)]) < 0.42
        assert abs(np.corrcoef(found[0], found[1])[0, 1]) < 0.35


@pytest.mark.parametrize("method", ["bootstrap", "shuffle"])
def test_monte_carlo_of_every_account(spark, tmp_path, method):
    # keys beyond 300, in another order than their rows
    balances = {k: float((k * 7919) % 1100 - 500) for k in range(1, 321)}
    spark.createDataFrame(list(balances.items())[::-1], "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    returns = queries.order_returns(spark, str(tmp_path))
    own = [balances[k] / 2000 / 100 for k in sorted(balances)]
    np.testing.assert_allclose([r["r"] for r in returns.orderBy("step").collect()], own)
    terminal, depth = [], []
    for sim in range(6):
        draws = [int(hashlib.md5(f"{sim}-{step}-7".encode()).hexdigest()[:8], 16) for step in range(len(own))]
        at = [d % len(own) for d in draws] if method == "bootstrap" else plain_permutation(len(own), sim, 7)
        path = np.cumprod([1 + own[k] for k in at])
        peak = np.maximum.accumulate(path)
        terminal.append(path[-1])
        depth.append(((peak - path) / peak).max())
    row = montecarlo.robustness(returns, n_sims=6, seed=7, method=method).first()
    want = [np.mean(np.array(terminal) < 1), np.mean(depth) * 100, *np.quantile(terminal, [0.05, 0.5, 0.95]), np.quantile(depth, 0.95) * 100]
    got = [row[c] for c in ("probability_of_loss", "expected_worst_drawdown", "terminal_equity_p05", "terminal_equity_p50", "terminal_equity_p95", "drawdown_p95")]
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 997])
def test_a_shuffle_backwards_gives_the_steps(n):
    for sim in range(3):
        images = np.array(plain_permutation(n, sim, 5))
        assert montecarlo._unpermuted(images, sim, 5, n).tolist() == list(range(n))


@pytest.mark.parametrize("length", [1_000_000, 70])
@pytest.mark.parametrize("lowest", [-0.3, -1.5])
def test_packed_shuffles_are_those_of_rows(spark, monkeypatch, length, lowest):
    rng = np.random.default_rng(6)
    values = [lowest, None, *rng.normal(0.001, 0.05, 300).tolist(), float("nan"), *rng.normal(0.001, 0.05, 100).tolist()]
    returns = spark.createDataFrame(list(enumerate(values)), "step bigint, r double").repartition(3)
    monkeypatch.setattr(blocks, "LONG_ROWS", length)
    monkeypatch.setattr(montecarlo, "TASK_STEPS", 500)

    def report(rows):
        monkeypatch.setattr(montecarlo, "PACKED_ROWS", rows)
        return montecarlo.robustness(returns, n_sims=7, seed=3, method="shuffle", initial_equity=2.0).first().asDict()

    packed, calls = [], montecarlo.shuffled_metrics
    monkeypatch.setattr(montecarlo, "shuffled_metrics", lambda *a, **k: packed.append(a[1]) or calls(*a, **k))
    got = report(100)
    # a return below -1 makes equity negative, whose drawdowns blocks don't tell: those shuffles stay rows
    assert packed == ([401] if lowest > -1 else []) and got == pytest.approx(report(10**9))
    paths = montecarlo.simulate_trade_paths(returns, n_sims=2, seed=3, method="shuffle").toPandas()
    assert len(paths) == 802 and sorted(paths.r[paths["sim"] == 1]) == sorted(v for v in values if v is not None and v == v)


def test_quality(spark):
    rows = [(1, "2024-01-01", 1.0, 2.0, 0.5, 1.5, 1.0), (2, "2024-01-04", 1.0, 0.5, 0.5, -1.0, None), (3, "2024-01-02", 1.0, 2.0, 1.5, 1.5, 1.0), (4, "x", None, 2.0, 0.5, 1.5, 1.0)]
    df = spark.createDataFrame(rows, "n int, ts string, open double, high double, low double, close double, volume double")
    found = {r["code"]: r["count"] for r in quality.validate_ohlc(df, sequence_col="n", expected_freq="1D").collect()}
    assert found == {"invalid_timestamp": 1, "timestamp_not_monotonic": 1, "non_numeric_ohlc": 1, "non_positive_close": 1, "high_below_open_or_close": 1, "low_above_open_or_close": 2, "invalid_volume": 1, "missing_bars": 1}
    assert quality.validate_ohlc(df.where("1 = 0")).first()["code"] == "empty_ohlc" and quality.validate_ohlc(df.drop("low")).first()["code"] == "missing_ohlc_columns"
    with pytest.raises(ValueError, match="invalid_volume"):
        quality.raise_if_errors(quality.validate_ohlc(df))


def test_views(spark):
    curve = series_of(spark, range(100))
    got = [r["close"] for r in views.downsampled(curve, Series(), 7).orderBy("ts").collect()]
    assert got == [float(k) for k in np.unique(np.linspace(0, 99, 7).astype(int))]
    assert views.filter_options(spark.createDataFrame([(1, "x"), (2, "x")], "a int, b string"), ["a", "b"]).count() == 3


def test_live_stream_matches_batch(spark, sf_dir, tmp_path):
    from quantloom.queries import order_events
    from quantloom.streaming.live import live_order_ratios

    orders = order_events(spark, sf_dir).limit(500)
    orders.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    query = live_order_ratios(stream, "1 day").writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = live_order_ratios(spark.read.parquet(str(tmp_path / "in")), "1 day")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, batch.collect()))


def test_trades_of_empty(spark):
    assert trades_of(simulate(split_bars(spark), [Strategy()])).count() == 0
