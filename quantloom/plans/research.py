"""Research protocols: in-sample and out-of-sample metrics, walk-forward folds, parameter stability."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import Series
from ..operators.align import micros
from ..operators.backtest import simulate, trades_of
from ..operators.metrics import EPS, period_metrics, strategy_metrics
from ..sources.shared import stored
from .strategy import Backtest, Result, Sweep

Range = tuple[str, str]


@dataclass(frozen=True)
class Protocol:
    """Ranges (closed) and limits of a study; a range that isn't given follows from the data."""

    start: str | None = None
    end: str | None = None
    in_sample: Range | None = None
    out_sample: Range | None = None
    calendar: str = "crypto_365"
    periods_per_year: float | None = None
    min_oos_trades: int = 5
    sharpe_decay_warn: float = 0.50
    return_decay_warn: float = 0.50
    drawdown_expansion_warn: float = 1.50


def _ranges(rows: DataFrame, keyed: Series, protocol: Protocol) -> DataFrame:
    """``rows`` once for each range that holds them, named by ``label``."""
    kind = rows.schema[keyed.ts].dataType
    rows = rows.withColumns({"__first": F.min(keyed.ts).over(keyed.whole()), "__last": F.max(keyed.ts).over(keyed.whole())})
    first, last = F.col("__first"), F.col("__last")

    def at(given: str | None, default: Column) -> Column:
        return default if given is None else F.lit(given).cast(kind)

    start, end = at(protocol.start, first), at(protocol.end, last)
    inside = protocol.in_sample or (None, None)
    outside = protocol.out_sample or (None, None)
    to = at(inside[1], end)
    spans = {"full": (start, end), "in_sample": (at(inside[0], start), to), "out_sample": (at(outside[0], to), at(outside[1], end))}
    labels = F.array(*(F.struct(F.lit(k).alias("label"), a.alias("a"), b.alias("b")) for k, (a, b) in spans.items()))
    wide = rows.withColumn("__range", F.explode(labels))
    t = F.col(keyed.ts)
    return wide.where((t >= F.col("__range.a")) & (t <= F.col("__range.b"))).withColumn("label", F.col("__range.label")).drop("__range", "__first", "__last")


def split_metrics(result: Result, protocol: Protocol) -> DataFrame:
    """Metrics of each strategy by ``label``: full, in_sample, out_sample. Equity isn't simulated anew; a trade belongs where it exits."""
    result = result.stored()
    labelled = _ranges(result.rows, result.keyed, protocol)
    series = Series((*result.series.keys, "label"), result.series.ts)
    keyed = Series((*series.keys, "strategy_id"), series.ts)
    return strategy_metrics(labelled.drop("trades"), trades_of(labelled, series), keyed, periods_per_year=protocol.periods_per_year, calendar=protocol.calendar)


def _decay(inside: Column, outside: Column) -> Column:
    flat = F.abs(inside) <= EPS
    return F.when(flat, F.when(F.abs(outside) <= EPS, 0.0).otherwise(-1.0)).otherwise((inside - outside) / F.when(~flat, F.abs(inside)))


def validation(metrics: DataFrame, protocol: Protocol, keys: Sequence[str] = ("symbol", "strategy_id")) -> DataFrame:
    """How far out-of-sample metrics fall behind in-sample ones, as decays, warnings and a score, from ``split_metrics``."""
    names = ("period_sharpe", "return_pct", "max_drawdown_pct", "num_trades")
    sides = {p: [F.coalesce(F.max(F.when(F.col("label") == p, F.col(n))), F.lit(0)).cast("double").alias(f"{p}_{n}") for n in names] for p in ("in_sample", "out_sample")}
    wide = metrics.groupBy(*keys).agg(*sides["in_sample"], *sides["out_sample"])
    s = {p: {n: F.col(f"{p}_{n}") for n in names} for p in sides}
    inside, outside = s["in_sample"], s["out_sample"]
    sharpe, ret = _decay(inside["period_sharpe"], outside["period_sharpe"]), _decay(inside["return_pct"], outside["return_pct"])
    deeper = F.when(outside["max_drawdown_pct"] > 0, outside["max_drawdown_pct"] / F.greatest(inside["max_drawdown_pct"], F.lit(EPS)) - 1).otherwise(0.0)
    few = protocol.min_oos_trades - outside["num_trades"]
    # fixed values: the names of warnings and the weights of the score
    warned = {
        "oos_trades_too_few": few > 0,
        "oos_sharpe_drops_too_much": (inside["period_sharpe"] > 0) & (sharpe > protocol.sharpe_decay_warn),
        "oos_return_collapses": (inside["return_pct"] > 0) & (ret > protocol.return_decay_warn),
        "oos_drawdown_much_worse_than_is": (inside["max_drawdown_pct"] > 0) & (deeper > protocol.drawdown_expansion_warn),
    }
    zero = F.lit(0.0)
    score = 100 - 35 * F.greatest(sharpe, zero) - 30 * F.greatest(ret, zero) - 15 * F.greatest(deeper, zero) - 3 * F.greatest(few, zero)
    return wide.select(
        *keys,
        sharpe.alias("oos_sharpe_decay"),
        ret.alias("oos_return_decay"),
        deeper.alias("oos_mdd_expansion"),
        F.greatest(F.least(score, F.lit(100.0)), zero).alias("is_oos_consistency_score"),
        F.lit(None).cast("double").alias("parameter_stability_score"),
        (~reduce(or_, warned.values())).alias("oos_pass"),
        F.filter(F.array(*(F.when(w, F.lit(n)) for n, w in warned.items())), lambda x: x.isNotNull()).alias("warnings"),
    )


def flat_research(result: Result, protocol: Protocol) -> DataFrame:
    """One row a strategy: full metrics, ``in_sample_*``, ``out_sample_*`` and ``validation_*``, warnings joined by commas."""
    keys = [*result.series.keys, "strategy_id"]
    metrics = stored(split_metrics(result, protocol), "split-metrics")
    values = [c for c in metrics.columns if c not in (*keys, "label")]
    wide = metrics.groupBy(*keys).agg(*(F.max(F.when(F.col("label") == p, F.col(v))).alias(v if p == "full" else f"{p}_{v}") for p in ("full", "in_sample", "out_sample") for v in values))
    checked = validation(metrics, protocol, keys).withColumn("warnings", F.array_join("warnings", ","))
    return wide.join(checked.select(*keys, *(F.col(c).alias(f"validation_{c}") for c in checked.columns if c not in keys)), keys)


def rank(table: DataFrame, objective: str = "sharpe") -> DataFrame:
    """Best first: by the objective (``sharpe`` if there is no such column), then the return, then the name."""
    by = objective if objective in table.columns else "sharpe"
    return table.orderBy(F.desc(by), F.desc("return_pct"), "strategy_id")


def folds(start, end, train: str, test: str, step: str) -> list[tuple]:
    """``(fold, train_start, test_start, test_end)`` in microseconds, as long as a test range begins by ``end``."""
    a, b, c = micros(train), micros(test), micros(step)
    if min(a, b, c) <= 0:
        raise ValueError("train, test and step must be positive")
    out, at = [], start
    while at + a <= end:
        out.append((len(out), at, at + a, at + a + b))
        at += c
    return out


@dataclass(frozen=True)
class WalkForward:
    """``folds`` with best strategy and metrics, ``combined`` out-of-sample metrics, ``stability`` of the choice, ``path``."""

    folds: DataFrame
    combined: DataFrame
    stability: DataFrame
    path: DataFrame


def walk_forward(plan: Backtest | Sweep, *, train_window: str = "730D", test_window: str = "180D", step: str = "180D", objective: str = "period_sharpe", calendar: str = "crypto_365") -> WalkForward:
    """Trains on ``[s, s + train)``, tests on ``[s + train, + test)``, moves on by ``step``; all folds run in one job.

    Each bar goes to the folds that hold it; every (fold, phase) is a series of its own, so transforms
    start cold. The best strategy of a fold is the first by ``objective`` and return on its training bars.
    """
    base = plan.base if isinstance(plan, Sweep) else plan
    strategies = plan.strategies() if isinstance(plan, Sweep) else [plan.strategy]
    keys, ts = list(base.series.keys), base.series.ts
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = base.bars.agg(F.min(now), F.max(now)).first()
    plans = folds(lo, hi, train_window, test_window, step) if lo is not None else []
    sides = [(k, "train", a, b) for k, a, b, _ in plans] + [(k, "test", b, min(c, hi + 1)) for k, _, b, c in plans]
    spec = "array<struct<fold:int,side:string,a:bigint,b:bigint>>"
    spans = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(s).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, s, a, b in sides)).cast(spec)
    bars = base.bars.withColumn("__in", F.explode(F.filter(spans, lambda x: (now >= x["a"]) & (now < x["b"]))))
    bars = bars.withColumns({"fold": F.col("__in.fold"), "phase": F.col("__in.side")}).drop("__in")
    series = Series((*keys, "fold", "phase"), ts)
    rows = stored(simulate(bars, strategies, series, base.capital), "walk-forward")
    metrics = strategy_metrics(rows.drop("trades"), trades_of(rows, series), Series((*series.keys, "strategy_id"), ts), calendar=calendar)
    metrics = stored(metrics, "fold-metrics")
    by = objective if objective in metrics.columns else "sharpe"
    trained = metrics.where("phase = 'train'")
    order = Window.partitionBy(*keys, "fold").orderBy(F.desc(by), F.desc("return_pct"), "strategy_id")
    best = trained.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*keys, "fold", "strategy_id")
    values = [c for c in metrics.columns if c not in (*series.keys, "strategy_id")]
    chosen = metrics.join(best, [*keys, "fold", "strategy_id"])
    found = chosen.groupBy(*keys, "fold", "strategy_id").agg(*(F.max(F.when(F.col("phase") == s, F.col(v))).alias(f"{s}_{v}") for s in ("train", "test") for v in values))
    times = base.bars.sparkSession.createDataFrame([(k, a, b, min(c, hi)) for k, a, b, c in plans], "fold int, a bigint, b bigint, c bigint")
    kind = base.bars.schema[ts].dataType
    shown = {n: F.timestamp_micros(v).cast(kind).alias(n) for n, v in (("train_start", "a"), ("train_end", "b"), ("test_start", "b"), ("test_end", "c"))}
    found = found.join(times.select("fold", *shown.values()), "fold")
    tested = rows.where("phase = 'test'").join(best, [*keys, "fold", "strategy_id"])
    own = Series((*keys, "fold"), ts)
    r = F.coalesce(F.col("equity") / F.lag("equity").over(own.ordered()) - 1, F.lit(0.0))
    tested = tested.withColumns({"r": r, "n": F.count("*").over(own.whole()), "e0": F.first("equity").over(own.running())}).where("n > 1 AND e0 > 0")
    chain = Window.partitionBy(*keys).orderBy("fold", ts).rowsBetween(Window.unboundedPreceding, 0)
    path = tested.select(*keys, "fold", ts, "r").withColumn("equity", F.product(1 + F.col("r")).over(chain) * base.capital)
    stability = found.groupBy(*keys).agg(F.count("*").alias("fold_count"), F.countDistinct("strategy_id").alias("unique_best_param_sets"))
    stability = stability.withColumn("param_reuse_ratio", 1 - (F.col("unique_best_param_sets") - 1) / F.col("fold_count"))
    return WalkForward(found, period_metrics(path, Series(tuple(keys), ts), calendar=calendar), stability, path)


def parameter_stability(table: DataFrame, params: Sequence[str], objective: str = "period_sharpe", by: Sequence[str] = ()) -> DataFrame:
    """How steady the objective is around its best parameters, over a sweep's results (a row a strategy): a row for each ``by``, or one row.

    Besides scores it has the best parameters by the objective over the whole range, in sample and out of sample.
    Values equal to nine places are equal where they are ordered or ranked: strategies that trade alike over a range
    differ in the last digits if they came to it with another equity.
    """
    metric = objective if objective in table.columns else "sharpe"
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    numeric = [p for p in params if kinds[p] in ("bigint", "int", "double", "float")]
    by = list(by)
    all_rows = Window.partitionBy(*(by or [F.lit(0)]))  # a row a strategy
    m = F.col(metric).cast("double")
    rows = table.withColumns({"m": m, "n": F.count("*").over(all_rows), "place": F.row_number().over(all_rows.orderBy(F.desc(F.round(m, 9)), "strategy_id"))})
    top = rows.where("place = 1")
    far = F.lit(0.0)
    for p in numeric:
        best = F.max(F.when(F.col("place") == 1, F.col(p))).over(all_rows)
        span = F.greatest((F.max(p).over(all_rows) - F.min(p).over(all_rows)).cast("double"), F.lit(EPS))
        far += F.pow((F.col(p) - best) / span, 2)
    rows = rows.withColumn("distance", F.sqrt(far))
    rows = rows.withColumns({
        "near": F.percentile(F.when(F.col("distance") > 0, F.col("distance")), F.lit(0.25)).over(all_rows),
        "best": F.max("m").over(all_rows),
        "jump": F.abs(F.col("m") - F.lag("m").over(all_rows.orderBy(*numeric, "strategy_id"))) if numeric else F.lit(None).cast("double"),
    })
    ranked = all(f"{p}_{metric}" in table.columns for p in ("in_sample", "out_sample"))
    sides = [f"{p}_{metric if ranked else 'period_sharpe'}" for p in ("in_sample", "out_sample")]
    known = all(s in table.columns for s in sides)
    for k, s in enumerate(sides):
        both = F.col(sides[0]).isNotNull() & F.col(sides[1]).isNotNull() if known else None
        value = F.when(both, F.round(s, 9)) if known else F.lit(None).cast("double")
        # the average rank of equal values
        rows = rows.withColumn(f"v{k}", value)
        rows = rows.withColumn(f"rank{k}", F.when(F.col(f"v{k}").isNotNull(), F.rank().over(all_rows.orderBy(F.asc_nulls_last(f"v{k}"))) + (F.count("*").over(Window.partitionBy(*by, f"v{k}")) - 1) / 2))
    out = rows.groupBy(*by).agg(
        F.max("best").alias("best"),
        F.avg(F.when((F.col("distance") > 0) & (F.col("distance") <= F.col("near")), F.col("m"))).alias("around"),
        F.avg("jump").alias("jump"),
        F.max("n").alias("n"),
        F.avg(F.when(F.col("place") <= F.greatest(F.ceil(F.col("n") * 0.1), F.lit(1)), F.when(F.col("m") > 0, 1.0).otherwise(0.0))).alias("top"),
        F.corr("rank0", "rank1").alias("corr"),
    )
    zero = F.lit(0.0)
    decay = F.coalesce(F.when(F.abs("best") > EPS, (F.col("best") - F.col("around")) / F.when(F.col("best") != 0, F.abs("best"))), zero)
    smooth = F.when(F.col("n") > 1, F.coalesce(1 / (1 + F.col("jump")), F.lit(1.0))).otherwise(0.0) if numeric else zero
    corr = F.coalesce(F.when(~F.isnan("corr"), F.col("corr")), zero)
    score = 100 - 35 * F.greatest(decay, zero) + 15 * F.coalesce("top", zero) + 20 * smooth + 30 * F.greatest(corr, zero)
    chosen = F.struct(*(F.col(p) for p in params)) if params else F.struct(F.col("strategy_id"))
    best_row = top.groupBy(*by).agg(F.first(chosen).alias("best_params"))
    # the best in and out of sample, of those equal to nine places the first by name; without such columns the best row, and none
    for k, name in enumerate(("best_is_params", "best_oos_params")):
        if known:
            first = F.min(F.when(F.col(sides[k]).isNotNull(), F.struct((-F.round(sides[k], 9)).alias("m"), "strategy_id", chosen.alias("own"))))["own"]
            own = table.groupBy(*by).agg(first.alias(name))
        else:
            own = best_row.select(*by, (F.col("best_params") if k == 0 else F.when(F.lit(False), F.col("best_params"))).alias(name))
        best_row = best_row.join(own, by) if by else best_row.crossJoin(own)  # one row each
    scores = out.select(
        *by,
        F.greatest(F.least(score, F.lit(100.0)), zero).alias("parameter_stability_score"),
        decay.alias("neighbor_sharpe_decay"),
        F.coalesce("top", zero).alias("top_decile_consistency"),
        smooth.alias("heatmap_smoothness_score"),
        F.greatest(corr, zero).alias("oos_rank_consistency"),
        corr.alias("is_oos_rank_corr"),
    )
    return scores.join(best_row, by) if by else scores.crossJoin(best_row)  # one row each
