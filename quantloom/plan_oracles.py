"""DuckDB SQL for sweeps, research splits, walk-forward folds and parameter stability."""

from __future__ import annotations

import itertools

from .oracles import HOURS, PERIOD, PERIOD_NAMES, TRADE_VALUES, TRADED, rounding, rules

#: The sweep's parameters; a wide sweep has more values of some.
PARAMS = ("rolling_window", "long_threshold", "short_threshold", "exit_signal", "take_profit_pct", "stop_loss_pct")
NARROW = ((10, 20), (0.5, 1.0), (-1.0, -0.5), (0.0, None), (40.0,), (-30.0,))
WIDE = ((10, 20, 40), (0.5, 1.0), (-1.0, -0.5), (0.0, None), (40.0, None), (-30.0, -60.0))
SUMMARY = ("usable_start", "usable_end", "usable_rows", "num_trades", "sharpe", "max_drawdown", "net_profit", "avg_trade_pct", "max_drawdown_start", "max_drawdown_end", "max_drawdown_recovery")
METRICS = (*SUMMARY, *(n for n in (*PERIOD_NAMES, *TRADE_VALUES) if n != "periods_per_year"))
DATES = ("usable_start", "usable_end", "max_drawdown_start", "max_drawdown_end", "max_drawdown_recovery")
COUNTS = ("usable_rows", "num_trades")


def strategies(grid: tuple) -> str:
    """A table "strat" of all combinations of parameters."""
    rows = []
    for own in itertools.product(*grid):
        name = "__".join(["sweep", *(f"{p}-{'NONE' if v is None else v}" for p, v in zip(PARAMS, own))])
        rows.append(f"('{name}', {', '.join('NULL' if v is None else str(v) if p == 'rolling_window' else f'{v}::DOUBLE' for p, v in zip(PARAMS, own))})")
    return f"strat({', '.join(('sid', *PARAMS))}) AS (VALUES {', '.join(rows)})"


def folded(grid: tuple, keyed: str) -> str:
    """Tables "curves" and "trades" of all strategies over the series ``k`` of a table of bars; ``symbol`` is ``k~sid``."""
    order = "PARTITION BY k ORDER BY ts"
    scores = []
    for n in grid[0]:
        frame = f"({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        scores.append(f"SELECT k, ts, high, low, close, {n} AS rolling_window, CASE WHEN count(close) OVER {frame} >= {n} THEN (close - avg(close) OVER {frame}) / nullif(stddev_pop(close) OVER {frame}, 0) END AS z FROM ({keyed})")
    each = "(PARTITION BY k, rolling_window ORDER BY ts)"
    crossed = {"le": "z >= {0} AND (pz IS NULL OR pz < {0})", "se": "z <= {1} AND (pz IS NULL OR pz > {1})", "lx": "coalesce(z <= {2} AND (pz IS NULL OR pz > {2}), false)", "sx": "coalesce(z >= {2} AND (pz IS NULL OR pz < {2}), false)"}
    hits = ", ".join(f"{v.format('long_threshold', 'short_threshold', 'exit_signal')} AS {n}" for n, v in crossed.items())
    return f"""{strategies(grid)}, z AS ({" UNION ALL ".join(scores)}), p AS (SELECT *, row_number() OVER {each} - 1 AS idx, lag(z) OVER {each} AS pz FROM z WHERE z IS NOT NULL),
      b AS (SELECT k || '~' || sid AS symbol, idx, ts, close, high, low, z, {hits}, stop_loss_pct AS stop, take_profit_pct AS take, max(idx) OVER (PARTITION BY k, sid) AS last, NULL::DOUBLE AS c0 FROM p JOIN strat USING (rolling_window)), {rules(0.05, 0.00055, 0.0)}"""


#: All metrics of tables "curves" and "trades", a row a symbol.
MEASURED = f"""{PERIOD}, span AS (SELECT symbol, count(*) AS usable_rows, min(ts) AS usable_start, max(ts) AS usable_end, greatest((epoch(max(ts)) - epoch(min(ts))) / 86400.0, 1) AS days, arg_max(e, ts) - arg_min(e, ts) AS net_profit FROM curves GROUP BY 1), {TRADED},
  measured AS (SELECT symbol, usable_start, usable_end, usable_rows, coalesce(num_trades, 0) AS num_trades, coalesce(trade_sharpe, 0) AS sharpe, max_drawdown_pct AS max_drawdown, net_profit, coalesce(avg_trade_return, 0) AS avg_trade_pct,
    start AS max_drawdown_start, since AS max_drawdown_end, recovery AS max_drawdown_recovery, {", ".join(f"coalesce({n}, 0)::DOUBLE AS {n}" for n in METRICS if n not in SUMMARY)}
    FROM span JOIN period USING (symbol) JOIN dd USING (symbol) LEFT JOIN traded USING (symbol))"""


def part(n: int) -> str:
    return f"split_part(symbol, '~', {n})"


def rounded(names) -> str:
    return ", ".join(n if n.removeprefix("in_sample_").removeprefix("out_sample_").removeprefix("train_").removeprefix("test_") in (*DATES, *COUNTS) else f"{rounding(n)} AS {n}" for n in names)


def sweep_rank() -> str:
    digits = dict.fromkeys(("return_pct", "max_drawdown", "net_profit", "cagr_pct", "win_rate", "avg_trade_pct"), 2) | dict.fromkeys(("cagr", "fee_drag", "slippage_drag", "gross_pnl", "net_pnl"), 6)
    shown = [n if n in ("usable_start", "usable_end", *COUNTS) else f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}" if n in DATES else f"{rounding(n, digits.get(n, 3))} AS {n}" for n in METRICS]
    return f"""WITH RECURSIVE {HOURS}, {folded(WIDE, "SELECT symbol AS k, * FROM bars")}, {MEASURED}
      SELECT {part(1)} AS symbol, {part(2)} AS strategy_id, {", ".join(PARAMS)}, {", ".join(shown)} FROM measured JOIN strat ON sid = {part(2)}"""


def _decay(name: str) -> str:
    i, o = f"coalesce(in_sample_{name}, 0)", f"coalesce(out_sample_{name}, 0)"
    return f"CASE WHEN abs({i}) <= 1e-12 THEN CASE WHEN abs({o}) <= 1e-12 THEN 0.0 ELSE -1.0 END ELSE ({i} - {o}) / abs({i}) END"


#: A row a symbol and strategy: full metrics, those in and out of sample, and the validation of one by the other.
RESEARCHED = f"""{HOURS}, {folded(NARROW, "SELECT symbol AS k, * FROM bars")},
  ranges(label, a, b) AS (VALUES ('full', TIMESTAMP '0001-01-01', TIMESTAMP '9999-01-01'), ('in_sample', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-18'), ('out_sample', TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-31')),
  whole_curves AS (SELECT symbol || '~' || label AS symbol, ts, e FROM curves JOIN ranges ON ts BETWEEN a AND b), whole_trades AS (SELECT t.* REPLACE (symbol || '~' || label AS symbol) FROM trades t JOIN ranges ON exit_ts BETWEEN a AND b),
  {MEASURED.replace("FROM curves", "FROM whole_curves").replace("FROM trades", "FROM whole_trades")},
  wide AS (SELECT {part(1)} AS symbol, {part(2)} AS sid, {", ".join(f"max({m}) FILTER ({part(3)} = '{p}') AS {m if p == 'full' else f'{p}_{m}'}" for p in ("full", "in_sample", "out_sample") for m in METRICS)} FROM measured GROUP BY 1, 2),
  decayed AS (SELECT *, {_decay("period_sharpe")} AS dsh, {_decay("return_pct")} AS dre, CASE WHEN coalesce(out_sample_max_drawdown_pct, 0) > 0 THEN out_sample_max_drawdown_pct / greatest(coalesce(in_sample_max_drawdown_pct, 0), 1e-12) - 1 ELSE 0.0 END AS dd,
    5 - coalesce(out_sample_num_trades, 0) AS few FROM wide),
  warned AS (SELECT *, list_filter([CASE WHEN few > 0 THEN 'oos_trades_too_few' END, CASE WHEN in_sample_period_sharpe > 0 AND dsh > 0.5 THEN 'oos_sharpe_drops_too_much' END, CASE WHEN in_sample_return_pct > 0 AND dre > 0.5 THEN 'oos_return_collapses' END,
    CASE WHEN in_sample_max_drawdown_pct > 0 AND dd > 1.5 THEN 'oos_drawdown_much_worse_than_is' END], lambda x: x IS NOT NULL) AS w, greatest(least(100 - 35 * greatest(dsh, 0) - 30 * greatest(dre, 0) - 15 * greatest(dd, 0) - 3 * greatest(few, 0), 100), 0) AS score FROM decayed)"""


def research_split() -> str:
    names = [m if p == "full" else f"{p}_{m}" for p in ("full", "in_sample", "out_sample") for m in METRICS]
    return f"""WITH RECURSIVE {RESEARCHED}
      SELECT symbol, sid AS strategy_id, {", ".join(PARAMS)}, {rounded(names)}, {rounding("dsh")} AS validation_oos_sharpe_decay, {rounding("dre")} AS validation_oos_return_decay, {rounding("dd")} AS validation_oos_mdd_expansion,
        {rounding("score")} AS validation_is_oos_consistency_score, NULL::DOUBLE AS validation_parameter_stability_score, len(w) = 0 AS validation_oos_pass, array_to_string(w, ',') AS validation_warnings FROM warned JOIN strat USING (sid)"""


def stability() -> str:
    numeric = ("rolling_window", "long_threshold", "short_threshold", "exit_signal")
    far = " + ".join(f"pow(({p} - max(CASE WHEN place = 1 THEN {p} END) OVER s) / greatest((max({p}) OVER s - min({p}) OVER s)::DOUBLE, 1e-12), 2)" for p in numeric)
    shown = f"to_json({{{{{', '.join(f"'{p}': {{t}}.{p}" for p in numeric)}}}}})::VARCHAR"
    ranks = ", ".join(f"rank() OVER (PARTITION BY symbol ORDER BY v{k}) + (count(*) OVER (PARTITION BY symbol, v{k}) - 1) / 2.0 AS r{k}" for k in (0, 1))
    return f"""WITH RECURSIVE {RESEARCHED}, tried AS (SELECT symbol, sid, {", ".join(numeric)}, period_sharpe AS m, round(in_sample_period_sharpe, 9) AS v0, round(out_sample_period_sharpe, 9) AS v1, count(*) OVER (PARTITION BY symbol) AS n,
        row_number() OVER (PARTITION BY symbol ORDER BY round(period_sharpe, 9) DESC, sid) AS place, {", ".join(f"row_number() OVER (PARTITION BY symbol ORDER BY round({side}_period_sharpe, 9) DESC NULLS LAST, sid) AS p{k}" for k, side in enumerate(("in_sample", "out_sample")))} FROM wide JOIN strat USING (sid)),
      u AS (SELECT *, sqrt({far}) AS distance, abs(m - lag(m) OVER (PARTITION BY symbol ORDER BY {", ".join(f"{p} NULLS FIRST" for p in numeric)}, sid)) AS jump, {ranks} FROM tried WINDOW s AS (PARTITION BY symbol)),
      q AS (SELECT symbol, quantile_cont(distance, 0.25) FILTER (distance > 0) AS near FROM u GROUP BY 1),
      near AS (SELECT symbol, max(m) AS best, avg(m) FILTER (distance > 0 AND distance <= near) AS around, avg(jump) AS jump, max(n) AS n, avg((m > 0)::INT) FILTER (place <= greatest(ceil(n * 0.1), 1)) AS top, coalesce(corr(r0, r1), 0) AS c FROM u JOIN q USING (symbol) GROUP BY 1),
      scored AS (SELECT *, coalesce((best - around) / nullif(abs(best), 0), 0) AS decay, CASE WHEN n > 1 THEN coalesce(1 / (1 + jump), 1) ELSE 0 END AS smooth FROM near)
      SELECT scored.symbol, {rounding("greatest(least(100 - 35 * greatest(decay, 0) + 15 * coalesce(top, 0) + 20 * smooth + 30 * greatest(c, 0), 100), 0)")} AS parameter_stability_score, {rounding("decay")} AS neighbor_sharpe_decay, {rounding("coalesce(top, 0)")} AS top_decile_consistency,
        {rounding("smooth")} AS heatmap_smoothness_score, {rounding("greatest(c, 0)")} AS oos_rank_consistency, {rounding("c")} AS is_oos_rank_corr, {", ".join(f"{shown.format(t=t)} AS {n}" for t, n in (("tried", "best_params"), ("inside", "best_is_params"), ("outside", "best_oos_params")))}
      FROM scored JOIN tried ON tried.symbol = scored.symbol AND tried.place = 1 JOIN tried inside ON inside.symbol = scored.symbol AND inside.p0 = 1 JOIN tried outside ON outside.symbol = scored.symbol AND outside.p1 = 1"""


#: Folds of 10 days of training and 5 of test, a step of 5 days: starts as long as a test begins by the last bar.
_FOLDS = """ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars), folds AS (SELECT range::INT AS fold, lo + range * INTERVAL 5 DAY AS a, lo + range * INTERVAL 5 DAY + INTERVAL 10 DAY AS m, least(lo + range * INTERVAL 5 DAY + INTERVAL 15 DAY, hi) AS z,
    lo + range * INTERVAL 5 DAY + INTERVAL 15 DAY AS stop, hi FROM ends, range(1000) WHERE lo + range * INTERVAL 5 DAY + INTERVAL 10 DAY <= hi),
  sides AS (SELECT fold, 'train' AS phase, a, m AS b FROM folds UNION ALL SELECT fold, 'test', m, CASE WHEN stop > hi THEN hi + INTERVAL 1 MICROSECOND ELSE stop END FROM folds),
  dealt AS (SELECT symbol || '~' || fold || '~' || phase AS k, bars.* FROM bars JOIN sides ON ts >= a AND ts < b)"""


def walk_forward_folds() -> str:
    names = [f"{p}_{m}" for p in ("train", "test") for m in METRICS]
    values = ", ".join(f"max(m.{m}) FILTER ({_own(3)} = '{p}') AS {p}_{m}" for p in ("train", "test") for m in METRICS)
    return f"""WITH RECURSIVE {HOURS}, {_FOLDS}, {folded(NARROW, "SELECT * FROM dealt")}, {MEASURED},
      best AS (SELECT {part(1)} AS sym, {part(2)} AS fold, {part(4)} AS sid, row_number() OVER (PARTITION BY {part(1)}, {part(2)} ORDER BY round(period_sharpe, 9) DESC, round(return_pct, 9) DESC, {part(4)}) AS place FROM measured WHERE {part(3)} = 'train'),
      found AS (SELECT sym, best.fold, best.sid, {values} FROM measured m JOIN best ON place = 1 AND sym = {_own(1)} AND best.fold = {_own(2)} AND best.sid = {_own(4)} GROUP BY 1, 2, 3)
      SELECT sym AS symbol, found.fold::INT AS fold, sid AS strategy_id, {rounded(names)}, a AS train_start, m AS train_end, m AS test_start, z AS test_end FROM found JOIN folds ON folds.fold = found.fold::INT"""


def _own(n: int) -> str:
    return f"split_part(m.symbol, '~', {n})"


def walk_forward_combined() -> str:
    """One strategy: its path over the test ranges of all folds, and how steady the choice is."""
    frame = "(PARTITION BY k ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"""WITH RECURSIVE {HOURS}, {_FOLDS}, z AS (SELECT *, CASE WHEN count(close) OVER {frame} >= 20 THEN (close - avg(close) OVER {frame}) / nullif(stddev_pop(close) OVER {frame}, 0) END AS z FROM dealt),
      p AS (SELECT k AS symbol, ts, high, low, close, z, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS idx, lag(z) OVER (PARTITION BY k ORDER BY ts) AS pz FROM z WHERE z IS NOT NULL),
      b AS (SELECT *, z >= 1 AND (pz IS NULL OR pz < 1) AS le, z <= -1 AND (pz IS NULL OR pz > -1) AS se, z <= 0 AND (pz IS NULL OR pz > 0) AS lx, z >= 0 AND (pz IS NULL OR pz < 0) AS sx,
        -30::DOUBLE AS stop, 40::DOUBLE AS take, max(idx) OVER (PARTITION BY symbol) AS last, NULL::DOUBLE AS c0 FROM p), {rules(0.05, 0.001, 0.0005).replace("curves AS (", "fold_curves AS (")},
      tested AS (SELECT {part(1)} AS symbol, {part(2)}::INT AS fold, ts, coalesce(e / lag(e) OVER w - 1, 0) AS r, count(*) OVER (PARTITION BY symbol) AS n, first(e) OVER w AS e0 FROM fold_curves WHERE {part(3)} = 'test' WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      ranked AS (SELECT symbol, ts, 1 + r AS g, row_number() OVER (PARTITION BY symbol ORDER BY fold, ts) AS k FROM tested WHERE n > 1 AND e0 > 0),
      grows AS (SELECT symbol, ts, k, g FROM ranked WHERE k = 1 UNION ALL SELECT r.symbol, r.ts, r.k, p.g * r.g FROM grows p JOIN ranked r ON r.symbol = p.symbol AND r.k = p.k + 1),
      curves AS (SELECT symbol, ts, g * 100 AS e FROM grows), {PERIOD},
      chosen AS (SELECT {part(1)} AS symbol, count(DISTINCT {part(2)}) AS fold_count FROM fold_curves WHERE {part(3)} = 'train' GROUP BY 1)
      SELECT symbol, points, {rounded(PERIOD_NAMES)}, start AS max_drawdown_start, since AS max_drawdown_end, recovery AS max_drawdown_recovery, fold_count, 1::BIGINT AS unique_best_param_sets, 1::DOUBLE AS param_reuse_ratio
      FROM period JOIN dd USING (symbol) JOIN chosen USING (symbol)"""


ORACLES: dict[str, str] = {"d_walkforward_combined": walk_forward_combined(), "d_sweep_rank": sweep_rank(), "d_research_split": research_split(), "d_stability": stability(), "d_walkforward_folds": walk_forward_folds()}
