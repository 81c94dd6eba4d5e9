"""Long series in blocks: the same rows as series in one task, spread over many tasks."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import blocks
from quantloom.functions.blocks import AT, BLOCK, deal, grouped_quantile, has_long_series, in_blocks
from quantloom.functions.series import Series
from quantloom.functions.transforms import apply_transform, apply_transforms
from quantloom.operators import metrics, montecarlo

START = datetime(2024, 1, 1)


@pytest.fixture
def long(monkeypatch):
    monkeypatch.setattr(blocks, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)


@pytest.fixture(scope="module")
def gaps(spark):
    """One long series, a medium and several short ones, one of them without a name; gaps, some of them long, and a series of gaps alone."""
    rng = np.random.default_rng(8)
    rows = []
    for symbol, n in (("a", 900), ("b", 130), (None, 60), ("c", 1), ("d", 7), ("e", 40)):
        x = 50 + np.cumsum(rng.normal(size=n))
        known = rng.random(n) > 0.2
        known[300:460], known[:2] = False, False
        rows += [(symbol, START + timedelta(hours=k), float(v) if ok and symbol != "e" else None) for k, (v, ok) in enumerate(zip(x, known))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").repartition(5).cache()


def values(df):
    return {(r["symbol"], r["ts"]): r["x"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None), k
        assert w is None or got[k] == pytest.approx(w, rel=1e-9, abs=1e-9), k


STEPS = [
    ("identity", {}),
    ("zscore", {"window": 20}),
    ("zscore", {"window": 12, "min_periods": 4, "ddof": 1}),
    ("sma", {"window": 150}),
    ("minmax", {}),
    ("minmax", {"window": 9}),
    ("robust_zscore", {"window": 7}),
    ("pct_change", {"periods": 1}),
    ("pct_change", {"periods": 5}),
    *(("ema", {"span": s, "adjust": a}) for s in (1, 5, 60) for a in (False, True)),
]


@pytest.mark.parametrize(("name", "options"), STEPS)
def test_transforms_in_blocks(spark, gaps, monkeypatch, name, options):
    want = values(apply_transform(gaps, name, "x", Series(), **options))
    monkeypatch.setattr(blocks, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)
    out = apply_transform(gaps, name, "x", Series(), **options)
    assert out.columns == gaps.columns
    same(values(out), want)


def test_pipelines_share_blocks(spark, gaps, monkeypatch):
    steps = [("sma", {"window": 30}), ("zscore", {"window": 10}), ("ema", {"span": 4}), ("pct_change", {}), ("sma", {"window": 3})]
    want = values(apply_transforms(gaps, steps, "x", Series()))
    monkeypatch.setattr(blocks, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)
    same(values(apply_transforms(gaps, steps, "x", Series())), want)


def test_small_batches(spark, gaps, long):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for adjust in (False, True):
            got = apply_transform(gaps, "ema", "x", Series(), span=5, adjust=adjust).where("symbol = 'a'").orderBy("ts").toPandas()["x"]
            x = gaps.where("symbol = 'a'").orderBy("ts").toPandas()["x"]
            np.testing.assert_allclose(got, x.ewm(span=5, adjust=adjust).mean(), equal_nan=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_long_series_uses_many_tasks(spark, gaps, long):
    assert has_long_series(gaps, Series()) and not has_long_series(gaps.where("symbol = 'd'"), Series())
    own = deal(gaps, Series())
    chain = [r for r in own.borders if r["symbol"] == "a"]
    assert len(chain) >= 6 and sum(r["n"] for r in chain) == 900 and max(r["n"] for r in chain) < 300
    assert all(r["symbol"] not in ("c", "d") for r in own.borders)
    # one place a row, blocks in order of time
    rows = own.rows.where("symbol = 'a'").orderBy("ts").select(BLOCK, AT).collect()
    assert rows == sorted(rows) and len({r[AT] for r in rows}) == 900
    out = own.with_halo(250)
    n = {r["symbol"]: r["count"] for r in out.where("__halo").groupBy("symbol").count().collect()}
    assert n["a"] > 1000 and set(n) <= {"a", "b", None, "e"}
    tasks = in_blocks(gaps, Series(), 3, lambda rows, own: rows.withColumn("task", F.spark_partition_id()).withColumn("x", F.sum("x").over(own.last_rows(3))).withColumn("task", F.spark_partition_id()))
    assert tasks.where("symbol = 'a'").select("task").distinct().count() > 1


@pytest.mark.parametrize("kind", ["max", "sum", "product", "last"])
def test_running_values(spark, gaps, long, kind):
    own = deal(gaps.withColumn("x", F.col("x") / 50), Series())
    found = own.running(own.rows, "y", F.col("x"), kind).select("symbol", "ts", F.col("y").alias("x"))
    want = {}
    for symbol, rows in gaps.toPandas().sort_values("ts").groupby("symbol", dropna=False):
        x = rows["x"] / 50
        run = {"max": lambda: x.cummax().ffill(), "sum": lambda: x.cumsum().ffill(), "product": lambda: x.cumprod().ffill(), "last": lambda: x.ffill()}[kind]()
        want |= {(symbol if isinstance(symbol, str) else None, t.to_pydatetime()): None if np.isnan(v) else v for t, v in zip(rows["ts"], run)}
    same(values(found), want)


def test_empty(spark, gaps, long):
    none = gaps.where("1 = 0")
    assert in_blocks(none, Series(), 5, lambda rows, own: rows).count() == 0
    assert deal(none, Series()).borders == ()


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 1.0])
def test_grouped_quantile(spark, gaps, long, q):
    skewed = gaps.withColumn("x", F.when(F.hour("ts") % 3 == 0, 7.0).otherwise(F.col("x")))
    found = {r["symbol"]: r["x"] for r in grouped_quantile(skewed, ["symbol"], "x", q, "x").collect()}
    want = skewed.where("x IS NOT NULL").groupBy("symbol").agg(F.percentile("x", F.lit(q)).alias("x")).collect()
    assert found == pytest.approx({r["symbol"]: r["x"] for r in want})


def test_metrics_of_long_curves(spark, gaps, monkeypatch):
    curve = gaps.withColumnRenamed("x", "equity").where("symbol IS NULL OR symbol <> 'e'")
    rows = lambda f: {r["symbol"]: r.asDict() for r in f(curve, Series()).collect()}
    want = [rows(f) for f in (metrics.drawdowns, metrics.period_metrics)]
    monkeypatch.setattr(blocks, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)
    for f, own in zip((metrics.drawdowns, metrics.period_metrics), want):
        found = rows(f)
        assert found.keys() == own.keys()
        for k in own:
            for name, value in own[k].items():
                assert found[k][name] == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value), (k, name)


def test_metrics_of_many_trades(spark, gaps, monkeypatch):
    trades = gaps.where("x IS NOT NULL").select("symbol", F.col("ts").alias("entry_ts"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("exit_ts"), (F.col("x") - 50).alias("pnl_pct"))
    trades = trades.withColumns({c: F.col("pnl_pct") / 7 for c in ("pnl_cash", "account_return_pct")} | {c: F.lit(1.0) for c in ("bars_held", "allocated_capital", "fee_cash", "slippage_cash")})
    rows = lambda: {r["symbol"]: r.asDict() for r in metrics.trade_metrics(trades, ["symbol"], total_days=F.lit(30.0)).collect()}
    want = rows()
    monkeypatch.setattr(blocks, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)
    found = rows()
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("method", montecarlo.METHODS)
def test_long_paths(spark, monkeypatch, method):
    rng = np.random.default_rng(2)
    returns = spark.createDataFrame([(k, float(r)) for k, r in enumerate(rng.normal(0, 0.05, 150))], "step bigint, r double")
    paths = lambda: {(r["sim"], r["step"]): r["equity"] for r in montecarlo.simulate_trade_paths(returns, n_sims=4, seed=3, method=method).collect()}
    report = lambda: montecarlo.robustness(returns, n_sims=4, seed=3, method=method).first().asDict()
    want, summed = paths(), report()
    monkeypatch.setattr(blocks, "LONG_ROWS", 10)
    assert paths() == pytest.approx(want) and report() == pytest.approx(summed)
