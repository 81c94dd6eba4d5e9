"""DuckDB SQL for the registered queries, over views of the same tables."""

from __future__ import annotations

#: Bars of each event type.
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('{every}', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
HOURS, DAYS = BARS.format(every="hour"), BARS.format(every="day")
OWN = "PARTITION BY symbol ORDER BY ts"


def rounding(value: str, places: int = 6) -> str:
    """To nine places first, so that a value halfway between two roundings doesn't depend on the order of sums."""
    return f"coalesce(round(TRY_CAST({value} AS DECIMAL(38, 9)), {places})::DOUBLE, round({value}::DOUBLE, {places})) + 0.0"


def rows(n: int) -> str:
    return f"({OWN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def transform(value: str) -> str:
    return f"WITH {HOURS}, b AS (SELECT symbol, ts, close AS c FROM bars) SELECT symbol, ts, round({value}, 6) + 0.0 AS x FROM b"


def zscore(n: int, least: int, std: str = "stddev_pop", c: str = "c") -> str:
    return f"CASE WHEN count({c}) OVER {rows(n)} >= {least} THEN ({c} - avg({c}) OVER {rows(n)}) / nullif({std}({c}) OVER {rows(n)}, 0) END"


def asof(direction: str) -> str:
    """Bars with the signal of all events available 30 seconds before, before or after by direction."""
    back = "SELECT b.symbol, b.ts, s.available_ts AS t FROM bars b ASOF LEFT JOIN s ON b.ts - INTERVAL 30 SECONDS >= s.available_ts"
    ahead = "SELECT b.symbol, b.ts, s.available_ts AS t FROM bars b ASOF LEFT JOIN s ON b.ts - INTERVAL 30 SECONDS <= s.available_ts"
    nearest = f"""SELECT x.symbol, x.ts, CASE WHEN y.t IS NOT NULL AND (x.t IS NULL OR y.t - (x.ts - INTERVAL 30 SECONDS) < (x.ts - INTERVAL 30 SECONDS) - x.t) THEN y.t ELSE x.t END AS t
      FROM ({back}) x JOIN ({ahead}) y USING (symbol, ts)"""
    chosen = {"backward": back, "forward": ahead, "nearest": nearest}[direction]
    return f"""WITH {HOURS}, s AS (SELECT ts AS event_ts, ts + INTERVAL 5 MINUTES AS available_ts, value FROM events),
      m AS ({chosen}), a AS (SELECT b.symbol, b.ts, b.close, s.event_ts, s.available_ts, s.value, epoch_us(b.ts) - epoch_us(s.available_ts) AS age,
        coalesce(s.available_ts <= b.ts - INTERVAL 30 SECONDS, false) AS safe FROM m JOIN bars b USING (symbol, ts) LEFT JOIN s ON s.available_ts = m.t)
      SELECT symbol, ts, round(close, 6) AS close, CASE WHEN safe AND NOT coalesce(age > 3600000000, false) THEN round(value, 6) END AS signal, event_ts AS signal_event_ts,
        available_ts AS signal_available_ts, round(age / 1e6, 6) AS signal_age_seconds, coalesce(age > 3600000000, false) AS is_stale_signal, safe AS lookahead_safe FROM a"""


CURVES = f"""days AS (SELECT o_orderstatus AS symbol, o_orderdate AS ts, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2),
  offs AS (SELECT symbol, ts, x - avg(x) OVER (PARTITION BY symbol) AS o FROM days),
  curves AS (SELECT symbol, ts, 1e8 + sum(o) OVER ({OWN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM offs)"""
#: From a table "curves" of (symbol, ts, e): returns, drawdowns and their summary.
RISK = f"""r AS (SELECT *, e / lag(e) OVER ({OWN}) - 1 AS r, epoch(ts) - epoch(lag(ts) OVER ({OWN})) AS dt, max(e) OVER ({OWN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM curves),
  d AS (SELECT *, (e - peak) / peak AS dd FROM r),
  low AS (SELECT symbol, min(dd) AS dd, arg_min(ts, (dd, ts)) AS since, arg_min(peak, (dd, ts)) AS peak, max(ts) AS t_n FROM d GROUP BY 1),
  dd AS (SELECT low.symbol, any_value(low.dd) AS depth, min(d.ts) FILTER (d.e >= low.peak - 1e-12 AND d.ts <= low.since) AS start, any_value(low.since) AS since,
    min(d.ts) FILTER (d.e >= low.peak - 1e-12 AND d.ts > low.since) AS recovery, any_value(low.t_n) AS t_n FROM d JOIN low USING (symbol) GROUP BY 1)"""
ROLL = f"({OWN} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
PERIOD = f"""{RISK}, k AS (SELECT *, count(r) OVER {ROLL} = 30 AS full_frame, avg(r) OVER {ROLL} AS rm, stddev_pop(r) OVER {ROLL} AS rs, stddev_pop(least(r, 0.0)) OVER {ROLL} AS rd FROM d WHERE r IS NOT NULL),
  v AS (SELECT symbol, quantile_cont(r, 0.05) AS q FROM k GROUP BY 1),
  a AS (SELECT symbol, count(*) + 1 AS points, avg(r) AS m, stddev_pop(r) AS s, coalesce(stddev_pop(r) FILTER (r < 0), 0) AS ds, any_value(q) AS q, avg(r) FILTER (r <= q) AS cv, skewness(r) AS sk, kurtosis(r) AS ku,
    arg_max(rm / nullif(rs, 0), ts) FILTER (full_frame) AS ro, arg_max(rm / nullif(rd, 0), ts) FILTER (full_frame) AS rod FROM k JOIN v USING (symbol) GROUP BY 1),
  f AS (SELECT symbol, arg_min(e, ts) AS e0, arg_max(e, ts) AS en, greatest((epoch(max(ts)) - epoch(min(ts))) / (365 * 86400.0), 1 / 365.0) AS years, greatest(365 * 86400 / median(dt) FILTER (dt > 0), 1.0) AS ppy FROM d GROUP BY 1),
  grown AS (SELECT *, exp(ln(en / e0) / years) - 1 AS cagr, sqrt(ppy) AS y FROM f),
  period AS (SELECT symbol, points, ppy AS periods_per_year, m / s * y AS period_sharpe, CASE WHEN ds > 1e-12 THEN m / ds * y ELSE 0 END AS sortino, coalesce(ro * y, 0) AS rolling_sharpe, coalesce(rod * y, 0) AS rolling_sortino,
    s * y * 100 AS volatility_annualized, ds * y * 100 AS downside_volatility, cagr, cagr * 100 AS cagr_pct, coalesce(cagr / nullif(round(-depth * 100, 6) / 100, 0), 0) AS calmar, (en / e0 - 1) * 100 AS return_pct,
    q * 100 AS VaR_95, cv * 100 AS CVaR_95, coalesce(sk, 0) AS skew, coalesce(ku, 0) AS kurtosis, -depth * 100 AS max_drawdown_pct, (epoch(coalesce(recovery, t_n)) - epoch(start)) / 86400.0 AS max_drawdown_duration_days
    FROM a JOIN grown USING (symbol) JOIN dd USING (symbol))"""
PERIOD_NAMES = "periods_per_year period_sharpe sortino rolling_sharpe rolling_sortino volatility_annualized downside_volatility cagr cagr_pct calmar return_pct VaR_95 CVaR_95 skew kurtosis max_drawdown_pct max_drawdown_duration_days".split()


def shown(names: list[str], places: int) -> str:
    return ", ".join(f"round({n}::DOUBLE, {places}) + 0.0 AS {n}" for n in names)


#: What ends an open position on a bar, from the rules' columns of "b".
_REASON = """CASE WHEN f.side = 0 THEN NULL WHEN f.side = 1 AND b.low <= f.price * (1 + b.stop / 100) OR f.side = -1 AND b.high >= f.price * (1 - b.stop / 100) THEN 'stop_loss'
  WHEN f.side = 1 AND b.high >= f.price * (1 + b.take / 100) OR f.side = -1 AND b.low <= f.price * (1 - b.take / 100) THEN 'take_profit'
  WHEN f.side = 1 AND b.lx OR f.side = -1 AND b.sx THEN 'signal_exit' END"""


def rules(size: float, fee: float, slip: float) -> str:
    """The position rules as a recursion over "b", bars with entries, exits and limits: tables "fold" after each bar, "curves" and "trades"."""
    size, cost, fee, slip = (f"{x}::DOUBLE" for x in (size, fee + slip, fee, slip))
    return f"""step AS (
    SELECT symbol, -1::BIGINT AS idx, 100::DOUBLE AS cash, 0 AS side, 0::DOUBLE AS price, 0::DOUBLE AS alloc, 0::DOUBLE AS units, -1::BIGINT AS since, NULL::VARCHAR AS reason, NULL::DOUBLE AS xprice, NULL::DOUBLE AS pnl,
      0 AS was_side, 0::DOUBLE AS was_price, 0::DOUBLE AS was_alloc, 0::DOUBLE AS was_units, -1::BIGINT AS was_at, 0::DOUBLE AS was_cash FROM (SELECT DISTINCT symbol FROM b)
    UNION ALL
    SELECT symbol, idx, CASE WHEN opened THEN cash - cash * {size} * {cost} ELSE cash + coalesce(pnl, 0) END, CASE WHEN reason IS NOT NULL THEN 0 WHEN opened THEN CASE WHEN le THEN 1 ELSE -1 END ELSE side END,
      CASE WHEN opened THEN close ELSE price END, CASE WHEN opened THEN cash * {size} ELSE alloc END, CASE WHEN opened THEN cash * {size} / close ELSE units END, CASE WHEN opened THEN idx ELSE since END,
      reason, xprice, pnl, side, price, alloc, units, since, cash
    FROM (SELECT *, units * (xprice - price) * side - alloc * {fee} - alloc * {slip} AS pnl, side = 0 AND (le OR se) AS opened
      FROM (SELECT *, CASE reason WHEN 'stop_loss' THEN price * (1 + side * stop / 100) WHEN 'take_profit' THEN price * (1 + side * take / 100) WHEN 'signal_exit' THEN close END AS xprice
        FROM (SELECT b.symbol, b.idx, b.close, b.le, b.se, b.stop, b.take, f.cash, f.side, f.price, f.alloc, f.units, f.since, {_REASON} AS reason FROM step f JOIN b ON b.symbol = f.symbol AND b.idx = f.idx + 1)))),
  ended AS (SELECT s.*, b.ts, b.close, b.z, b.last, b.c0, s.idx = b.last AND s.side <> 0 AS forced FROM step s JOIN b USING (symbol, idx)),
  fold AS (SELECT *, units * (close - price) * side - alloc * {fee} - alloc * {slip} AS last_pnl FROM ended),
  curves AS (SELECT symbol, ts, CASE WHEN forced THEN cash + last_pnl ELSE cash + units * (close - price) * side END AS e FROM fold),
  closed AS (SELECT symbol, idx, was_at AS since, was_side AS side, was_price AS price, xprice, was_alloc AS alloc, was_units AS units, pnl, was_cash AS cash, reason, ts, z FROM fold WHERE reason IS NOT NULL
    UNION ALL SELECT symbol, idx, since, side, price, close, alloc, units, last_pnl, cash, 'forced_end', ts, z FROM fold WHERE forced),
  trades AS (SELECT c.symbol, e.ts AS entry_ts, c.ts AS exit_ts, CASE c.side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS side, c.price AS entry_price, c.xprice AS exit_price, c.idx - c.since AS bars_held, {size} AS position_size_pct,
    c.alloc AS allocated_capital, c.units, c.pnl / c.alloc * 100 AS pnl_pct, c.pnl AS pnl_cash, c.pnl / c.cash * 100 AS account_return_pct, 2 * c.alloc * {fee} AS fee_cash, 2 * c.alloc * {slip} AS slippage_cash,
    e.z AS entry_signal, c.z AS exit_signal, c.reason AS exit_reason FROM closed c JOIN b e ON e.symbol = c.symbol AND e.idx = c.since)"""


BACKTEST = f"""{HOURS}, z AS (SELECT *, {zscore(20, 20, c="close")} AS z FROM bars),
  p AS (SELECT *, row_number() OVER ({OWN}) - 1 AS idx, lag(z) OVER ({OWN}) AS pz FROM z WHERE z IS NOT NULL),
  b AS (SELECT *, z >= 1 AND (pz IS NULL OR pz < 1) AS le, z <= -1 AND (pz IS NULL OR pz > -1) AS se, z <= 0 AND (pz IS NULL OR pz > 0) AS lx, z >= 0 AND (pz IS NULL OR pz < 0) AS sx,
    -30::DOUBLE AS stop, 40::DOUBLE AS take, max(idx) OVER (PARTITION BY symbol) AS last, first(close) OVER ({OWN}) AS c0 FROM p), {rules(0.05, 0.001, 0.0005)}"""
TRADE_NUMBERS = "entry_price exit_price position_size_pct allocated_capital units pnl_pct pnl_cash account_return_pct fee_cash slippage_cash entry_signal exit_signal".split()

GRID = f"""{DAYS}, w AS (SELECT ts, symbol, volume / sum(volume) OVER (PARTITION BY ts) AS v FROM bars),
  cells AS (SELECT t.ts, s.symbol FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s),
  filled AS (SELECT c.ts, c.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.ts) AS price, coalesce(last_value((w.v * 0.10::DOUBLE + w.v * 0.05::DOUBLE) IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.ts), 0) AS target
    FROM cells c LEFT JOIN bars b USING (ts, symbol) LEFT JOIN w USING (ts, symbol)),
  g AS (SELECT *, lag(price) OVER ({OWN}) AS prev, coalesce(lag(target) OVER ({OWN}), 0) AS held FROM filled)"""
#: The portfolio as a recursion: arrays of prices and targets by time, equity before and after trading.
FOLIO = f"""{GRID}, l AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, list(coalesce(price / prev, 1) ORDER BY symbol) AS rs, list(held ORDER BY symbol) AS hs, list(target ORDER BY symbol) AS ws FROM g GROUP BY ts),
  eq AS (SELECT 0::BIGINT AS k, NULL::TIMESTAMP AS ts, 100::DOUBLE AS pre, 100::DOUBLE AS equity, 0::DOUBLE AS traded, 0::DOUBLE AS gross, 0::DOUBLE AS net, NULL::DOUBLE AS turnover, 0::DOUBLE AS drift
    UNION ALL SELECT k, ts, pre, pre - 0.001::DOUBLE * traded, traded, pre * list_sum([abs(x) for x in ws]), pre * list_sum(ws), traded / greatest(last, 1e-12), list_avg([abs(pre * x / (pre - 0.001::DOUBLE * traded) - x) for x in ws])
    FROM (SELECT *, list_sum([abs(ws[i] * pre - hs[i] * rs[i] * was) for i in range(1, len(ws) + 1)]) AS traded
      FROM (SELECT l.k, l.ts, l.rs, l.hs, l.ws, e.pre AS was, e.equity AS last, e.equity + e.pre * list_sum([l.hs[i] * (l.rs[i] - 1) for i in range(1, len(l.ws) + 1)]) AS pre FROM eq e JOIN l ON l.k = e.k + 1))),
  folio AS (SELECT ts, pre AS pre_equity, equity, equity - net AS cash, gross AS gross_exposure, net AS net_exposure, CASE WHEN equity > 0 THEN gross / equity ELSE 0 END AS leverage, turnover,
    sum((traded > 1e-12)::BIGINT) OVER (ORDER BY k) AS rebalance_count, drift AS drift_from_target FROM eq WHERE k > 0),
  pos0 AS (SELECT g.*, f.pre_equity, f.equity, g.target * f.pre_equity / g.price AS position FROM g JOIN folio f USING (ts)),
  pos1 AS (SELECT *, coalesce(lag(position) OVER ({OWN}), 0) AS was FROM pos0),
  pos AS (SELECT ts, symbol, coalesce(position, 0) AS position, price, target AS target_weight, CASE WHEN equity > 0 THEN coalesce(position * price, 0) / equity ELSE 0 END AS actual_weight,
    sum(coalesce(was * (price - prev), 0)) OVER ({OWN}) AS pnl_by_symbol, sum(coalesce(abs(position - was) * price * 0.001::DOUBLE, 0)) OVER ({OWN}) AS fee_by_symbol FROM pos1)"""
FILLS = """fills AS (SELECT l_shipdate AS ts, l_returnflag = 'R' AS sells, l_extendedprice / l_quantity AS fp, p_retailprice AS ap, l_extendedprice * l_tax AS fee, s_nationkey::VARCHAR AS venue, l_quantity * 10 AS latency
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
POSITIONS = f"""pd AS (SELECT user_id::VARCHAR AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS x, arg_max(value, ts) AS mark FROM events GROUP BY 1, 2),
  pq AS (SELECT *, sum(x) OVER ({OWN}) AS q FROM pd)"""


def significant(x: str) -> str:
    """A number rounded to nine digits."""
    unit = f"pow(10, floor(log10(abs(nullif({x}, 0)))) - 8)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round(({x}) / {unit}) * {unit} END"


def monte_carlo(method: str) -> str:
    drawn = "SELECT sim, step, ('0x' || substr(md5(sim || '-' || step || '-7'), 1, 8))::BIGINT % n AS since FROM g"
    # rounds go on until a pair below n stands behind a multiple of six of them
    part = "('0x' || substr(md5('7-' || sim || '-' || j), {at}, 7))::BIGINT"
    rounds = f"""k AS (SELECT sim, j, {part.format(at=1)} AS a, {part.format(at=8)} AS b FROM (SELECT range AS sim FROM range(200)) CROSS JOIN (SELECT range AS j FROM range(6))),
      f AS (SELECT sim, step, n, w, step // w AS l, step % w AS r, 0 AS j FROM (SELECT *, ceil(sqrt(n))::BIGINT AS w FROM g)
        UNION ALL SELECT f.sim, step, n, w, r, (l + ((r + a) % 2147483647) * ((r + b) % 2147483647) % 2147483647) % w, f.j + 1 FROM f JOIN k ON k.sim = f.sim AND k.j = f.j % 6 WHERE f.j = 0 OR f.j % 6 > 0 OR l * w + r >= n),"""
    at = drawn if method == "bootstrap" else "SELECT sim, step, l * w + r AS since FROM f WHERE j > 0 AND j % 6 = 0 AND l * w + r < n"
    return f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS since, c_acctbal / 2000 / 100 AS r FROM customer), c AS (SELECT count(*) AS n FROM r),
      g AS (SELECT sim, step, n FROM (SELECT range AS sim FROM range(200)) CROSS JOIN c CROSS JOIN LATERAL (SELECT unnest(range(n)) AS step)), {rounds if method == "shuffle" else ""} s AS ({at}),
      p AS (SELECT sim, step, product(1 + r) OVER (PARTITION BY sim ORDER BY step) AS e FROM s JOIN r USING (since)),
      q AS (SELECT *, e / lag(e) OVER (PARTITION BY sim ORDER BY step) - 1 AS own, max(e) OVER (PARTITION BY sim ORDER BY step) AS peak FROM p),
      m AS (SELECT sim, arg_max(e, step) AS t, max((peak - e) / peak) AS dd, CASE WHEN stddev_pop(own) > 1e-12 THEN avg(own) / stddev_pop(own) ELSE 0 END AS sh FROM q GROUP BY 1)
      SELECT 200 AS n_sims, '{method}' AS method, round(avg((t < 1)::INT), 6) + 0.0 AS probability_of_loss, round(avg((sh < 0)::INT), 6) + 0.0 AS probability_sharpe_below_zero, round(avg(dd) * 100, 6) + 0.0 AS expected_worst_drawdown,
        {", ".join(f"{significant(f'quantile_cont(t, {q / 100})')} AS terminal_equity_p{q:02d}" for q in (5, 50, 95))}, round(quantile_cont(dd, 0.95) * 100, 6) + 0.0 AS drawdown_p95 FROM m"""


#: Events as "never" and "none" leave them: a null time t, a null or infinite x.
UNREADABLE = """u AS (SELECT event_type AS symbol, event_id, CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS t,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)"""


def issues(source: str, checks: dict[str, tuple[str, str]], by: str = "") -> str:
    own, per = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    parts = [f"SELECT {own}'{code}' AS code, '{severity}' AS severity, ({count})::BIGINT AS count FROM {source}{per}" for code, (severity, count) in checks.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE count > 0"


_ATTRIBUTED = "SELECT symbol, round(arg_max(round(pnl_by_symbol, 6), ts), 4) + 0.0 AS pnl, round(arg_max(round(fee_by_symbol, 6), ts), 4) + 0.0 AS fee FROM pos GROUP BY 1"
_FOLIO_NAMES = "pre_equity equity cash gross_exposure net_exposure leverage turnover drift_from_target".split()

#: Metrics of the trades of each series, from tables "trades" and "span" (days and points of the whole curve).
TRADED = """t AS (SELECT symbol, count(*) AS num_trades, avg(account_return_pct / 100) AS m, stddev_pop(account_return_pct / 100) AS s, coalesce(sum(pnl_cash) FILTER (pnl_cash > 0), 0) AS gross_pnl, coalesce(-sum(pnl_cash) FILTER (pnl_cash < 0), 0) AS lost,
    avg((account_return_pct > 0)::INT) * 100 AS win_rate, avg(pnl_pct) AS avg_trade_return, median(pnl_pct) AS median_trade_return, max(pnl_pct) AS best_trade, min(pnl_pct) AS worst_trade, avg(bars_held) AS avg_holding_bars, sum(bars_held) AS held,
    avg((epoch(exit_ts) - epoch(entry_ts)) / 86400.0) AS avg_holding_time, sum(abs(allocated_capital)) AS turnover, sum(fee_cash) AS fee_drag, sum(slippage_cash) AS slippage_drag, sum(pnl_cash) AS net_pnl FROM trades GROUP BY 1),
  traded AS (SELECT t.*, num_trades / days * 365 AS trades_per_year, least(held / usable_rows, 1) * 100 AS time_in_market_pct, CASE WHEN num_trades >= 2 AND s > 1e-12 THEN m / s * sqrt(num_trades / days * 365) ELSE 0 END AS trade_sharpe,
    CASE WHEN lost > 1e-12 THEN gross_pnl / lost ELSE gross_pnl END AS profit_factor FROM t JOIN span USING (symbol))"""
TRADE_VALUES = "trade_sharpe profit_factor win_rate avg_trade_return median_trade_return best_trade worst_trade avg_holding_bars avg_holding_time time_in_market_pct turnover fee_drag slippage_drag gross_pnl net_pnl trades_per_year".split()


def backtest_metrics() -> str:
    """Period and trade metrics of each series' backtest, rounded as reports show them."""
    digits = dict.fromkeys(("return_pct", "cagr_pct", "win_rate"), 2) | dict.fromkeys(("cagr", "fee_drag", "slippage_drag", "gross_pnl", "net_pnl"), 6)
    names = [n for n in (*PERIOD_NAMES, *TRADE_VALUES) if n != "periods_per_year"]
    values = ", ".join(f"{rounding(f'coalesce({n}, 0)', digits.get(n, 3))} AS {n}" for n in names)
    dates = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS max_drawdown_{n}" for n, c in (("start", "start"), ("end", "since"), ("recovery", "recovery")))
    return f"""WITH RECURSIVE {BACKTEST}, {PERIOD},
      span AS (SELECT symbol, count(*) AS usable_rows, min(ts) AS usable_start, max(ts) AS usable_end, greatest((epoch(max(ts)) - epoch(min(ts))) / 86400.0, 1) AS days, arg_max(e, ts) - arg_min(e, ts) AS net FROM curves GROUP BY 1), {TRADED}
      SELECT symbol, 'zscore' AS strategy_id, usable_start, usable_end, usable_rows, coalesce(num_trades, 0) AS num_trades, {rounding("coalesce(trade_sharpe, 0)", 3)} AS sharpe, {rounding("max_drawdown_pct", 2)} AS max_drawdown, {rounding("net", 2)} AS net_profit,
        {rounding("coalesce(avg_trade_return, 0)", 2)} AS avg_trade_pct, {dates}, {values} FROM span JOIN period USING (symbol) JOIN dd USING (symbol) LEFT JOIN traded USING (symbol)"""


_LINES = """t AS (SELECT l_returnflag AS symbol, l_linestatus AS strategy_id, l_orderkey * 10 + l_linenumber AS exit_idx, l_orderkey AS entry_idx, l_quantity::DOUBLE AS bars_held, l_discount::DOUBLE AS pnl_pct,
  l_extendedprice::DOUBLE AS allocated_capital, l_quantity::DOUBLE AS units, l_tax::DOUBLE AS account_return_pct FROM lineitem)"""
#: Lists of results, reports and the user's own transforms.
LISTS: dict[str, str] = {
    "o_last_trades": f"WITH {_LINES} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, strategy_id ORDER BY exit_idx DESC, entry_idx DESC) AS k FROM t) WHERE k <= 500",
    "o_trade_summary": f"""WITH {_LINES} SELECT symbol, strategy_id, count(*) AS trades, round(avg(bars_held), 6) AS avg_bars_held, max(pnl_pct) AS max_pnl_pct, min(pnl_pct) AS min_pnl_pct, round(avg(allocated_capital), 6) AS avg_allocated_capital,
      round(avg(units), 6) AS avg_units, round(avg(account_return_pct), 6) AS avg_account_return_pct FROM t GROUP BY 1, 2""",
    "o_filter_options": """SELECT DISTINCT 'rolling_window' AS param, c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT DISTINCT 'short_threshold', c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'strategy_id', 's' || c_custkey FROM customer""",
    "o_top_curves": "SELECT 's' || c_custkey AS strategy_id, c_acctbal AS sharpe, c_nationkey AS return_pct FROM customer ORDER BY c_acctbal DESC, c_nationkey DESC, 's' || c_custkey LIMIT 50",
    "o_objective_rank": "SELECT 's' || c_custkey AS strategy_id, -c_acctbal AS net_profit FROM customer ORDER BY c_acctbal, c_acctbal DESC, 's' || c_custkey LIMIT 25",
    "o_payload": """SELECT 's' || o_custkey AS strategy_id, count(*)::VARCHAR AS n, strftime(max(o_orderdate)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS last, strftime(min(o_orderdate)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS first_ts,
      min(o_orderkey)::VARCHAR AS first_key, count(*)::INTEGER AS n_bars, count(*)::INTEGER AS n_trades FROM orders GROUP BY o_custkey""",
    "o_research_report": "SELECT 's' || c_custkey AS strategy_id, c_mktsegment AS short_threshold, c_nationkey::VARCHAR AS rolling_window, c_acctbal::DOUBLE AS sortino FROM customer",
    "v_missing_columns": "SELECT code, 'error' AS severity, count::BIGINT AS count, source AS \"table\" FROM (VALUES ('missing_ohlc_columns', 2, 'ohlc'), ('missing_signal_columns', 1, 'signal')) v(code, count, source) WHERE (SELECT count(*) FROM events) > 0",
    "w_registered": f"WITH {HOURS}, b AS (SELECT symbol, ts, greatest(close, lag(close) OVER ({OWN})) AS x FROM bars) SELECT symbol, ts, round(x, 6) + 0.0 AS x, coalesce(floor(x) % 2 = 0, false) AS hit FROM b",
}

ORACLES: dict[str, str] = LISTS | {
    "s_ohlc_load": """WITH r AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS t, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1)
      SELECT t AS ts, t + INTERVAL 1 MINUTE AS close_ts, open, high, low, close, volume FROM r WHERE t BETWEEN '2024-01-05' AND '2024-01-19'""",
    "s_signal_load": "SELECT ts, min(value) AS signal_value FROM events WHERE event_type = 'error' AND value IS NOT NULL AND ts BETWEEN '2024-01-05' AND '2024-01-19' GROUP BY ts",
    "w_zscore": transform(zscore(20, 20)),
    "w_zscore_ddof": transform(zscore(12, 4, "stddev_samp")),
    "w_minmax": transform("(c - min(c) OVER (PARTITION BY symbol)) / nullif(max(c) OVER (PARTITION BY symbol) - min(c) OVER (PARTITION BY symbol), 0)"),
    "w_minmax_rolling": transform(f"CASE WHEN count(c) OVER {rows(24)} >= 24 THEN (c - min(c) OVER {rows(24)}) / nullif(max(c) OVER {rows(24)} - min(c) OVER {rows(24)}, 0) END"),
    "w_robust_zscore": f"""WITH {HOURS}, o AS (SELECT symbol, ts, CASE WHEN count(close) OVER {rows(11)} >= 11 THEN close - median(close) OVER {rows(11)} END AS o FROM bars)
      SELECT symbol, ts, round(CASE WHEN count(o) OVER {rows(11)} >= 11 THEN 0.6745::DOUBLE * o / nullif(median(abs(o)) OVER {rows(11)}, 0) END, 6) + 0.0 AS x FROM o""",
    "w_pct_change": transform(f"c / nullif(lag(c, 2) OVER ({OWN}), 0) - 1"),
    "w_identity": transform("c"),
    "w_sma": transform(f"CASE WHEN count(c) OVER {rows(24)} >= 24 THEN avg(c) OVER {rows(24)} END"),
    "w_ema": f"""WITH RECURSIVE {HOURS}, b AS (SELECT symbol, ts, close AS c, row_number() OVER ({OWN}) AS k FROM bars),
      e AS (SELECT symbol, ts, k, c AS x FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.ts, b.k, e.x * (1 - 2::DOUBLE / 21) + b.c * 2::DOUBLE / 21 FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1)
      SELECT symbol, ts, round(x, 6) + 0.0 AS x FROM e""",
    "w_composed": f"""WITH {HOURS}, m AS (SELECT symbol, ts, CASE WHEN count(close) OVER {rows(24)} >= 24 THEN avg(close) OVER {rows(24)} END AS m FROM bars)
      SELECT symbol, ts, round(m / nullif(lag(m) OVER ({OWN}), 0) - 1, 6) + 0.0 AS x FROM m""",
    "w_sliced": f"""WITH {HOURS}, b AS (SELECT symbol, ts, close AS c FROM bars WHERE ts >= '2024-01-05' AND ts < '2024-01-12 06:00:00') SELECT symbol, ts, round(CASE WHEN count(c) OVER {rows(12)} >= 12 THEN avg(c) OVER {rows(12)} END, 6) + 0.0 AS x FROM b""",
    "p_custom": f"""WITH {HOURS}, b AS (SELECT symbol, ts, close AS c, lag(close) OVER ({OWN}) AS p, lag(close, 2) OVER ({OWN}) AS q FROM bars) SELECT symbol, ts, coalesce(c > p AND p > q, false) AS hit FROM b""",
    "p_conditions": f"""WITH {HOURS}, b AS (SELECT symbol, ts, close AS c, lag(close) OVER ({OWN}) AS p FROM bars)
      SELECT symbol, ts, c >= 100 AS above, c < 50 AS below, c >= 100 AND (p IS NULL OR p < 100) AS cross_above, c <= 50 AND p IS NOT NULL AND p > 50 AS cross_below FROM b""",
    **{f"j_asof_{d}": asof(d) for d in ("backward", "forward", "nearest")},
    "j_asof_keyed": f"""WITH {HOURS} SELECT b.symbol, b.ts, b.close, e.value AS signal, e.ts AS signal_ts FROM bars b ASOF LEFT JOIN events e ON b.symbol = e.event_type AND b.ts >= e.ts""",
    "j_full_outer": f"""WITH {HOURS} SELECT ts, {", ".join(f"max(close) FILTER (symbol = '{s}') AS \"{s}\"" for s in ("click", "view", "error", "signup", "purchase"))} FROM bars GROUP BY ts""",
    "a_period_metrics": f"WITH {CURVES}, {PERIOD} SELECT symbol, points, {shown(PERIOD_NAMES, 4)} FROM period",
    "a_drawdown": f"""WITH {CURVES}, {RISK} SELECT symbol, round(-depth * 100, 4) + 0.0 AS max_drawdown_pct, start AS max_drawdown_start, since AS max_drawdown_end, recovery AS max_drawdown_recovery,
      round((epoch(coalesce(recovery, t_n)) - epoch(start)) / 86400.0, 4) + 0.0 AS max_drawdown_duration_days FROM dd""",
    "a_trade_metrics": f"""WITH RECURSIVE {BACKTEST}, t AS (SELECT symbol, count(*) AS n, avg(account_return_pct / 100) AS m, stddev_pop(account_return_pct / 100) AS s, coalesce(sum(pnl_cash) FILTER (pnl_cash > 0), 0) AS won, coalesce(-sum(pnl_cash) FILTER (pnl_cash < 0), 0) AS lost,
        avg((account_return_pct > 0)::INT) * 100 AS win_rate, avg(pnl_pct) AS avg_trade_return, median(pnl_pct) AS median_trade_return, max(pnl_pct) AS best_trade, min(pnl_pct) AS worst_trade, avg(bars_held) AS avg_holding_bars,
        avg((epoch(exit_ts) - epoch(entry_ts)) / 86400.0) AS avg_holding_time, least(sum(bars_held) / 720.0, 1) * 100 AS time_in_market_pct, sum(abs(allocated_capital)) AS turnover, sum(fee_cash) AS fee_drag, sum(slippage_cash) AS slippage_drag, sum(pnl_cash) AS net_pnl FROM trades GROUP BY 1),
      u AS (SELECT *, n AS num_trades, won AS gross_pnl, n / 30.0 * 365 AS trades_per_year, CASE WHEN n >= 2 AND s > 1e-12 THEN m / s * sqrt(n / 30.0 * 365) ELSE 0 END AS trade_sharpe, CASE WHEN lost > 1e-12 THEN won / lost ELSE won END AS profit_factor FROM t)
      SELECT symbol, num_trades, {shown("trade_sharpe profit_factor win_rate avg_trade_return median_trade_return best_trade worst_trade avg_holding_bars avg_holding_time time_in_market_pct turnover fee_drag slippage_drag gross_pnl net_pnl trades_per_year".split(), 4)} FROM u""",
    "d_backtest_trades": f"""WITH RECURSIVE {BACKTEST} SELECT symbol, 'zscore' AS strategy_id, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_date, strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_date, side, bars_held, exit_reason, {shown([n for n in TRADE_NUMBERS if n != 'units'], 6)}, {shown(['units'], 10)} FROM trades""",
    "d_backtest_equity": f"""WITH RECURSIVE {BACKTEST} SELECT symbol, ts, idx, round(e, 4) + 0.0 AS equity, side AS position, round(close / c0 * 100, 4) + 0.0 AS benchmark_equity FROM fold JOIN curves USING (symbol, ts)""",
    "d_backtest_metrics": backtest_metrics(),
    "o_detail_payload": f"""WITH RECURSIVE {BACKTEST}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts, entry_ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM trades),
      a AS (SELECT symbol, any_value(n) AS n, strftime(min(exit_ts) FILTER (k > n - 500), '%Y-%m-%d %H:%M:%S') AS last_exit, strftime(min(exit_ts), '%Y-%m-%dT%H:%M:%S') AS first_exit, count(*) FILTER (side = 'LONG') AS nl, count(*) FILTER (side = 'SHORT') AS ns FROM t GROUP BY 1),
      s AS (SELECT symbol, count(*) AS rows, min(ts) AS first FROM fold GROUP BY 1)
      SELECT symbol, rows::VARCHAR AS usable_rows, last_exit, n::VARCHAR AS trades, strftime(first, '%Y-%m-%dT%H:%M:%S') AS first_point, first_exit, '[-1.0,-1.0]' AS short_line, '[]' AS exit_line, 'Benchmark' AS benchmark,
        least(rows, 200)::INT AS n_points, nl::INT AS n_long, ns::INT AS n_short, least(rows, 200)::INT AS n_curve, least(n, 500)::INT AS n_trades FROM s JOIN a USING (symbol)""",
    "d_portfolio_metrics": f"""WITH RECURSIVE {FOLIO}, curves AS (SELECT 0 AS symbol, ts, equity AS e FROM folio), {PERIOD}, o AS (SELECT sum(turnover) AS turnover, max(rebalance_count)::BIGINT AS rebalance_count, avg(drift_from_target) AS drift_from_target,
      arg_max(gross_exposure, ts) AS gross_exposure, arg_max(net_exposure, ts) AS net_exposure, arg_max(leverage, ts) AS leverage FROM folio)
      SELECT points, {shown([n for n in PERIOD_NAMES if n not in ("cagr", "cagr_pct", "calmar")], 6)}, {", ".join(f"{significant(n)} AS {n}" for n in ("cagr", "cagr_pct", "calmar"))}, start AS max_drawdown_start, since AS max_drawdown_end, recovery AS max_drawdown_recovery, rebalance_count, {shown("gross_exposure net_exposure leverage turnover drift_from_target".split(), 6)} FROM period JOIN dd USING (symbol) CROSS JOIN o""",
    "o_portfolio_payload": f"""WITH {DAYS} SELECT 'folio' AS name, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_ts, min(symbol) AS first_symbol, count(DISTINCT ts)::VARCHAR AS points, count(DISTINCT ts)::INT AS n_equity, (count(DISTINCT ts) * count(DISTINCT symbol))::INT AS n_positions FROM bars""",
    "o_mode_is_oos": "SELECT 's' || c_custkey AS strategy_id, round(c_acctbal / 2, 6) + 0.0 AS in_sample_period_sharpe, round(c_acctbal - 100, 6) + 0.0 AS out_sample_period_sharpe FROM customer ORDER BY c_acctbal DESC, strategy_id LIMIT 20",
    "o_mode_sortino": "SELECT c_mktsegment AS short_threshold, c_nationkey AS rolling_window, max(c_acctbal) AS value FROM customer GROUP BY 1, 2",
    "d_portfolio_equity": f"WITH RECURSIVE {FOLIO} SELECT ts, rebalance_count::BIGINT AS rebalance_count, {shown(_FOLIO_NAMES, 6)} FROM folio",
    "d_portfolio_positions": f"WITH RECURSIVE {FOLIO} SELECT ts, symbol, {shown('position price target_weight actual_weight pnl_by_symbol fee_by_symbol'.split(), 6)} FROM pos",
    "d_portfolio_attribution": f"WITH RECURSIVE {FOLIO} {_ATTRIBUTED}",
    "d_portfolio_closed_form": f"WITH {GRID}, q AS (SELECT ts, 1 + sum(coalesce(held * (price / prev - 1), 0)) AS g FROM g GROUP BY 1) SELECT ts, round(100 * product(g) OVER (ORDER BY ts), 6) + 0.0 AS equity FROM q",
    "d_oms_ratios": "SELECT round(avg((o_orderstatus IN ('F', 'P'))::INT), 6) + 0.0 AS fill_ratio, round(avg((o_orderstatus NOT IN ('F', 'P'))::INT), 6) + 0.0 AS cancel_ratio, 0::DOUBLE AS reject_ratio FROM orders",
    "d_oms_execution": f"""WITH {FILLS}, b AS (SELECT *, CASE WHEN abs(ap) > 1e-12 THEN (CASE WHEN sells THEN ap - fp ELSE fp - ap END) / ap * 10000 END AS bps FROM fills)
      SELECT round(avg(bps), 3) + 0.0 AS average_slippage_bps, round(median(bps), 3) + 0.0 AS median_slippage_bps, round(avg(bps), 3) + 0.0 AS implementation_shortfall, round(avg(latency), 3) + 0.0 AS latency_ms, round(sum(fee), 3) + 0.0 AS fee_drag, 0::DOUBLE AS funding_drag FROM b""",
    "d_oms_venues": f"WITH {FILLS} SELECT venue, round(avg((fp - ap) / ap * 10000), 3) + 0.0 AS avg_slippage_bps, count(*) AS fills FROM fills GROUP BY 1",
    "d_oms_exposure": f"WITH {POSITIONS} SELECT symbol, round(sum(q * mark), 4) + 0.0 AS exposure FROM pq WHERE ts = (SELECT max(ts) FROM pq) GROUP BY 1",
    "d_oms_drift": f"""WITH {POSITIONS}, t AS (SELECT symbol, ts - INTERVAL 36 HOURS AS ts, q * 1.1::DOUBLE AS tq FROM pq), j AS (SELECT abs(pq.q - t.tq) AS d FROM pq ASOF JOIN t ON pq.symbol = t.symbol AND pq.ts >= t.ts)
      SELECT round((SELECT avg(d) FROM j), 3) + 0.0 AS target_vs_actual_position_drift, round(sum(x), 3) + 0.0 AS realized_pnl, round(sum(q * 0.01::DOUBLE), 3) + 0.0 AS unrealized_pnl FROM pq""",
    "d_oms_risk": f"WITH {CURVES}, {PERIOD} SELECT symbol, round(period_sharpe, 6) + 0.0 AS OMS_period_sharpe, round(max_drawdown_pct, 6) + 0.0 AS live_rolling_drawdown FROM period",
    "d_live_ratios": """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS window_start, count(*) AS orders, round(avg((o_orderstatus IN ('F', 'P'))::INT), 6) + 0.0 AS fill_ratio, round(avg((o_orderstatus NOT IN ('F', 'P'))::INT), 6) + 0.0 AS cancel_ratio, 0::DOUBLE AS reject_ratio FROM orders GROUP BY 1""",
    "d_live_slippage": f"""WITH {FILLS}, b AS (SELECT *, CASE WHEN abs(ap) > 1e-12 THEN (CASE WHEN sells THEN ap - fp ELSE fp - ap END) / ap * 10000 END AS bps FROM fills)
      SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, venue, count(*) AS fills, round(avg(bps), 3) + 0.0 AS avg_slippage_bps FROM b GROUP BY 1, 2""",
    "d_mc_bootstrap": monte_carlo("bootstrap"),
    "d_mc_shuffle": monte_carlo("shuffle"),
    "v_ohlc": f"""WITH {HOURS}, c AS (SELECT symbol, ts, hour(ts) AS h, open, CASE WHEN hour(ts) = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN hour(ts) = 5 THEN -close ELSE close END AS close, CASE WHEN hour(ts) <> 7 THEN volume END AS volume FROM bars),
      d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE h = 9) """
    + issues("d", {"non_positive_close": ("error", "count(*) FILTER (close <= 0)"), "high_below_open_or_close": ("error", "count(*) FILTER (high < greatest(open, close))"), "low_above_open_or_close": ("error", "count(*) FILTER (low > least(open, close))"),
      "invalid_volume": ("error", "count(*) FILTER (volume IS NULL OR volume < 0)"), "duplicate_timestamps": ("error", "count(*) - count(DISTINCT ts)"), "missing_bars": ("warning", "(epoch(max(ts)) - epoch(min(ts))) / 3600 + 1 - count(DISTINCT ts)")}, "symbol"),
    "v_ohlc_unreadable": f"""WITH {UNREADABLE}, o AS (SELECT *, CASE WHEN symbol = 'error' THEN -event_id ELSE event_id END AS seq FROM u),
      d AS (SELECT *, t IS NULL OR t < max(t) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM o) """
    + issues("d", {"invalid_timestamp": ("error", "count(*) FILTER (t IS NULL)"), "timestamp_not_monotonic": ("error", "max(bad::INT)"), "duplicate_timestamps": ("error", "count(*) - count(DISTINCT t) - (count(*) > count(t))::INT"), "non_positive_close": ("error", "count(*) FILTER (x <= 0)")}, "symbol")
    + "".join(f" UNION ALL SELECT symbol, 'non_numeric_ohlc', 'error', count(*) FILTER (x IS NULL) FROM d GROUP BY symbol HAVING count(*) FILTER (x IS NULL) > 0" for _ in range(4)),
    "v_signal_unreadable": f"""WITH {UNREADABLE}, d AS (SELECT *, CASE WHEN event_id % 79 <> 0 THEN t END AS e, CASE WHEN event_id % 73 <> 0 THEN t END AS a FROM u) """
    + issues("d", {"invalid_signal_timestamp": ("error", "count(*) FILTER (t IS NULL)"), "nan_signal": ("warning", "count(*) FILTER (x IS NULL)"), "inf_signal": ("error", "count(*) FILTER (isinf(x))"), "invalid_event_ts": ("error", "count(*) FILTER (e IS NULL)"),
      "invalid_available_ts": ("error", "count(*) FILTER (a IS NULL)"), "duplicate_signal_timestamps": ("error", "count(*) - count(DISTINCT t) - (count(*) > count(t))::INT")}, "symbol"),
    "v_signal": """WITH c AS (SELECT ts + INTERVAL 5 MINUTES AS a, date_trunc('hour', ts + INTERVAL 5 MINUTES) AS t, CASE WHEN value <= 150 THEN value END AS x, CASE WHEN minute(ts) < 5 THEN ts + INTERVAL 65 MINUTES ELSE ts END AS e FROM events) """
    + issues("c", {"nan_signal": ("warning", "count(*) FILTER (x IS NULL)"), "duplicate_signal_timestamps": ("warning", "count(*) - count(DISTINCT t)"), "available_before_event_ts": ("warning", "count(*) FILTER (a < e)"), "stale_signal": ("warning", "count(*) FILTER (epoch_us(t) - epoch_us(a) > -1800000000)")}),
    "o_downsample": f"""WITH {HOURS}, k AS (SELECT symbol, ts, close, row_number() OVER ({OWN}) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars), i AS (SELECT range AS i FROM range(100))
      SELECT DISTINCT symbol, ts, close FROM k, i WHERE n <= 100 OR k = (i * (n - 1)) // 99""",
    "o_heat_map": "SELECT year(o_orderdate)::INT AS year, o_orderstatus, round(max(o_totalprice), 6) + 0.0 AS value FROM orders GROUP BY 1, 2",
    "o_top_rows": "SELECT 's' || c_custkey AS strategy_id, c_mktsegment AS segment, c_acctbal AS sharpe, c_nationkey::DOUBLE AS return_pct FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY sharpe DESC, return_pct DESC, strategy_id LIMIT 20",
}
