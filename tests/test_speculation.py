"""Backtests of long series folded in blocks: the same rows as one scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from quantloom import queries
from quantloom.functions.conditions import Condition, cond
from quantloom.functions.series import Series
from quantloom.operators.backtest import Risk, Strategy, simulate
from quantloom.operators.fold import Fold
from quantloom.operators.speculation import advance, summary

START = datetime(2024, 1, 1)
NUMBERS = ("entry_price", "exit_price", "pnl_cash", "pnl_pct", "allocated_capital", "units", "account_return_pct", "fee_cash", "slippage_cash", "entry_signal", "exit_signal")


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(12)
    rows = []
    for symbol, n in (("a", 1200), (None, 200), ("b", 30), ("c", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        high, low = close * (1 + 0.04 * rng.random(n)), close * (1 - 0.04 * rng.random(n))
        for k in range(n):
            signal = None if 400 < k < 560 or rng.random() < 0.1 else float(rng.normal())
            rows.append((symbol, START + timedelta(hours=k), float(close[k]), float(high[k]), float(low[k]), signal))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double, signal double").repartition(4).cache()


@dataclass(frozen=True)
class AboveMean(Condition):
    """Looks back without bound."""

    def column(self, signal, series):
        return signal > F.avg(signal).over(series.running())


def strategies():
    rises = cond.custom(queries._two_rises, 2)
    out = []
    for k, (take, stop, again, size) in enumerate([(None, None, False, 0.5), (3.0, -2.0, False, 1.0), (6.0, -5.0, True, 0.3), (None, -8.0, True, 0.9), (12.0, None, False, 1.5)]):
        risk = Risk(size, 0.001, 0.0005, take, stop, again)
        out += [
            Strategy(f"s{k}", (), cond.above(1.0), cond.below(-1.0), cond.cross_below(0.2), cond.cross_above(-0.2), risk),
            Strategy(f"rare{k}", (), cond.above(2.2), cond.below(-2.4), None, None, risk),
            Strategy(f"z{k}", (("zscore", (("window", 12),)),), cond.cross_above(0.8), None, rises, None, risk),
            Strategy(f"late{k}", (("ema", (("span", 9),)),), rises, cond.cross_below(-0.3), cond.below(-0.2), cond.above(0.2), risk),
        ]
    return out


def folded(rows):
    out = {}
    for r in rows.collect():
        trades = tuple(tuple(t.asDict().items()) for t in r["trades"] or ())
        out[r["symbol"], r["strategy_id"], r["ts"]] = (r["idx"], r["position"], r["equity"], r["benchmark_equity"], trades)
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for k, (idx, position, equity, benchmark, trades) in want.items():
        assert got[k][:2] == (idx, position) and got[k][2:4] == pytest.approx((equity, benchmark)), k
        assert len(got[k][4]) == len(trades), k
        for a, b in zip(got[k][4], trades):
            a, b = dict(a), dict(b)
            assert {n: v for n, v in a.items() if n not in NUMBERS} == {n: v for n, v in b.items() if n not in NUMBERS}, k
            assert [a[n] for n in NUMBERS] == pytest.approx([b[n] for n in NUMBERS]), k


@pytest.mark.parametrize("parts", [3, 64])
def test_blocks_equal_the_scan(spark, bars, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = folded(simulate(bars, strategies(), Series(long=False)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        equal(folded(simulate(bars, strategies(), Series(long=True))), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conditions_that_see_whole_series(spark, bars):
    own = [Strategy("mean", (), AboveMean(), None, cond.below(-0.5), None, Risk(0.4, 0.001)), Strategy("plain", (), cond.above(0.5), None, cond.cross_below(0.0), None, Risk())]
    equal(folded(simulate(bars, own, Series(long=True))), folded(simulate(bars, own, Series(long=False))))


def test_series_of_one_block_and_none(spark, bars):
    own = strategies()[:2]
    equal(folded(simulate(bars.where("symbol = 'b'"), own, Series(long=True))), folded(simulate(bars.where("symbol = 'b'"), own, Series(long=False))))
    assert simulate(bars.where("1 = 0"), own, Series(long=True)).count() == 0


@pytest.mark.parametrize("trend", [-0.01, 0.0, 0.01])
def test_a_summary_ends_as_the_fold_does(trend):
    """From every state that the bars before can leave, for prices that only rise or fall too."""
    rng, n = np.random.default_rng(5), 400
    close = 100 * np.exp(trend * np.arange(n) + (trend == 0) * np.cumsum(rng.normal(0, 0.02, n)))
    hits = {name: rng.random(n) < 0.05 for name in ("long_entry", "short_entry", "long_exit", "short_exit")}
    ts = [type("T", (), {"as_py": lambda self, k=k: START + timedelta(hours=k)})() for k in range(n)]

    def part(a, b):
        return {c: v[a:b] for c, v in (hits | {"close": close, "high": close * 1.01, "low": close * 0.99, "signal": close}).items()} | {"ts": ts[a:b], "base": a}

    for take, stop, again in ((None, None, False), (2.0, -2.0, True), (None, -6.0, False), (9.0, None, True)):
        risk = Risk(0.7, 0.001, 0.0, take, stop, again)
        for cut in range(1, n - 50, 9):
            fold, other = Fold(risk, 100.0), Fold(risk, 100.0)
            for own in (fold, other):
                own.run(part(0, cut), False)
            fold.run(part(cut, n), False)
            advance(other, summary(part(cut, n), risk))
            assert other.side == fold.side and other.cash == pytest.approx(fold.cash)
            if fold.side:
                assert (other.at, other.ts, other.price, other.signal) == (fold.at, fold.ts, fold.price, fold.signal) and other.units == pytest.approx(fold.units)


def test_a_long_series_is_folded_by_many_tasks(spark, bars):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these blocks are small
    try:
        rows = simulate(bars, strategies()[:2], Series(long=True))
        tasks = rows.withColumn("task", F.spark_partition_id()).where("symbol = 'a'").select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 2
    order = Window.partitionBy("strategy_id").orderBy("ts")
    assert rows.where("symbol = 'a'").withColumn("gap", F.col("idx") - F.lag("idx").over(order)).where("gap <> 1").count() == 0
