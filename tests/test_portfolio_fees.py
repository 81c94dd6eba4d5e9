"""Portfolios with fees against a walk bar by bar."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio

START = datetime(2024, 1, 1)
NAMES = ("pre_equity", "equity", "cash", "gross_exposure", "net_exposure", "leverage", "turnover", "rebalance_count", "drift_from_target")


def walk(prices, targets, capital, fee):
    """``prices`` and ``targets`` by bar and symbol; a missing price is NaN."""
    held, cash, last, count, out = np.zeros(prices.shape[1]), capital, capital, 0, []
    for p, w in zip(prices, targets):
        known = ~np.isnan(p)
        at = np.where(known, p, 0.0)
        pre = cash + (held * at).sum()
        new = np.where(at != 0, w * pre / np.where(at != 0, at, 1.0), 0.0)
        traded = (abs(new - held) * at).sum()
        count += traded > 1e-12
        cash -= ((new - held) * at).sum() + traded * fee
        held, value = new, new * at
        equity = cash + value.sum()
        drift = abs(value / max(equity, 1e-12) - w)[known]
        out.append((pre, equity, cash, abs(value).sum(), value.sum(), abs(value).sum() / equity if equity > 0 else 0.0, traded / max(last, 1e-12), count, drift.mean() if known.any() else 0.0))
        last = equity
    return out


def paths(rng, n, m, size):
    prices = 100 * np.exp(np.cumsum(rng.normal(0, size, (n, m)), axis=0))
    prices[:3, : m - 1] = np.nan  # a time without any price is no bar
    targets = rng.normal(0, 0.6, (n, m)) * (rng.random((n, m)) > 0.3)
    targets[5] = targets[4]
    return prices, targets


def compared(spark, cases, fee, capital=100.0):
    rows, goals = [], []
    for name, (prices, targets) in cases.items():
        for k, (p, w) in enumerate(zip(prices, targets)):
            ts = START + timedelta(days=k)
            rows += [(name, ts, f"s{j}", None if np.isnan(x) else float(x)) for j, x in enumerate(p)]
            goals += [(name, ts, f"s{j}", float(x)) for j, x in enumerate(w)]
    bars = spark.createDataFrame(rows, "folio string, ts timestamp_ntz, symbol string, close double")
    wanted = spark.createDataFrame(goals, "folio string, ts timestamp_ntz, symbol string, target double")
    grid = portfolio.price_grid(bars, wanted, ["folio"])
    found = portfolio.portfolio_equity(grid, capital, fee, ["folio"]).orderBy("folio", "ts").collect()
    for name, (prices, targets) in cases.items():
        got = [[r[c] for c in NAMES] for r in found if r["folio"] == name]
        for k, (a, b) in enumerate(zip(got, walk(prices, targets, capital, fee), strict=True)):
            assert a == pytest.approx(b, rel=1e-8, abs=1e-8), (name, k)
    return grid


@pytest.mark.parametrize("fee", [0.0, 0.001, 0.08])
def test_equity_equals_the_walk(spark, fee):
    rng = np.random.default_rng(17)
    cases = {f"f{k}": paths(rng, 25, m, size) for k, (m, size) in enumerate(((1, 0.02), (6, 0.02), (40, 0.1)))}
    zero = paths(rng, 25, 4, 0.05)
    zero[0][9:12, 1] = 0.0
    flat = paths(rng, 25, 3, 0.0)
    compared(spark, cases | {"zero": zero, "flat": flat, "none": (zero[0], 0 * zero[1])}, fee)


def test_breaks_inside_the_range_are_few(spark):
    rng = np.random.default_rng(3)
    grid = compared(spark, {"wide": paths(rng, 20, 60, 0.03)}, 0.001)
    assert grid.count() == 20 * 60
    plan = portfolio.portfolio_equity(grid, 100.0, 0.001, ["folio"])
    assert plan.count() == 20 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_equity_that_comes_near_zero(spark):
    prices = np.array([[100.0, 50.0], [60.0, 50.0], [20.0, 51.0], [21.0, 52.0], [30.0, 40.0], [29.0, 41.0]])
    targets = np.array([[2.0, 0.1], [1.4, 0.2], [1.0, -1.0], [0.5, 0.5], [0.2, 0.7], [0.3, 0.3]])
    compared(spark, {"poor": (prices, targets)}, 0.15)


def test_without_prices(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz, symbol string, close double")
    grid = portfolio.price_grid(none, none.select("ts", "symbol", F.col("close").alias("target")))
    assert grid.count() == 0 and portfolio.portfolio_equity(grid, fee_pct=0.1).count() == 0
