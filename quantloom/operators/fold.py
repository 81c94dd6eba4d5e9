"""The position rules: risk settings, and the fold of one strategy over the bars of one series."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np

#: Bars in the first look for an exit; each further look takes twice as many.
LOOK = 64


@dataclass(frozen=True)
class Risk:
    """Sizes and costs are fractions; take-profit and stop-loss are percent, a stop-loss negative."""

    position_size_pct: float = 0.10
    fee_pct: float = 0.0
    slippage_pct: float = 0.0
    take_profit_pct: float | None = None
    stop_loss_pct: float | None = None
    allow_same_bar_reentry: bool = False


#: What a fold carries from bar to bar.
STATE = ("cash", "side", "price", "units", "allocated", "signal", "at", "ts")


class Fold:
    """State of one strategy over one series, carried from batch to batch."""

    def __init__(self, risk: Risk, capital: float) -> None:
        self.risk, self.cash, self.side = risk, capital, 0
        self.price = self.units = self.allocated = self.signal = 0.0
        self.at, self.ts = 0, None

    def resume(self, state: dict) -> None:
        """Goes on from a state that ``speculation`` has found."""
        for name in STATE:
            setattr(self, name, state[name])

    def levels(self) -> tuple[float | None, float | None]:
        stop, take, s = self.risk.stop_loss_pct, self.risk.take_profit_pct, self.side
        return (None if stop is None else self.price * (1 + s * stop / 100), None if take is None else self.price * (1 + s * take / 100))

    def _exits(self, b: dict, lo: int, hi: int) -> int | None:
        """The first bar of ``[lo, hi)`` with an exit."""
        stop, take = self.levels()
        bad, good = (b["low"], b["high"]) if self.side > 0 else (b["high"], b["low"])
        hit = b["long_exit" if self.side > 0 else "short_exit"][lo:hi].copy()
        if stop is not None:
            hit |= (bad[lo:hi] <= stop) if self.side > 0 else (bad[lo:hi] >= stop)
        if take is not None:
            hit |= (good[lo:hi] >= take) if self.side > 0 else (good[lo:hi] <= take)
        at = hit.argmax() if len(hit) else 0
        return lo + int(at) if len(hit) and hit[at] else None

    def exit_bar(self, b: dict, k: int, n: int) -> int | None:
        """The first bar from ``k`` on with an exit."""
        look, start, found = LOOK, k, None
        while start < n and found is None:
            found, start, look = self._exits(b, start, min(start + look, n)), start + look, 2 * look
        return found

    def close(self, b: dict, k: int, forced: bool) -> dict:
        stop, take = self.levels()
        price, reason = float(b["close"][k]), "forced_end" if forced else "signal_exit"
        if not forced:
            bad, good = (b["low"][k], b["high"][k]) if self.side > 0 else (b["high"][k], b["low"][k])
            if stop is not None and self.side * (bad - stop) <= 0:
                price, reason = stop, "stop_loss"
            elif take is not None and self.side * (good - take) >= 0:
                price, reason = take, "take_profit"
        fee, slip = self.allocated * self.risk.fee_pct, self.allocated * self.risk.slippage_pct
        pnl = self.units * (price - self.price) * self.side - fee - slip
        trade = {
            "entry_ts": self.ts, "exit_ts": b["ts"][k].as_py(), "side": "LONG" if self.side > 0 else "SHORT", "entry_price": self.price, "exit_price": price,
            "entry_idx": self.at, "exit_idx": b["base"] + k, "bars_held": b["base"] + k - self.at, "position_size_pct": self.risk.position_size_pct,
            "allocated_capital": self.allocated, "units": self.units, "pnl_pct": pnl / self.allocated * 100 if self.allocated > 0 else 0.0, "pnl_cash": pnl,
            "account_return_pct": pnl / self.cash * 100 if self.cash > 0 else 0.0, "fee_cash": 2 * fee, "slippage_cash": 2 * slip,
            "entry_signal": self.signal, "exit_signal": float(b["signal"][k]), "exit_reason": reason,
        }
        self.settle(price)
        return trade

    def settle(self, price: float) -> None:
        """Ends the position at a price."""
        fee, slip = self.allocated * self.risk.fee_pct, self.allocated * self.risk.slippage_pct
        self.cash += self.units * (price - self.price) * self.side - fee - slip
        self.side = 0

    def open(self, b: dict, k: int) -> None:
        self.enter(1 if b["long_entry"][k] else -1, float(b["close"][k]), float(b["signal"][k]), b["base"] + k, b["ts"][k].as_py())

    def enter(self, side: int, price: float, signal: float, at: int, ts: datetime) -> None:
        """Begins a position."""
        self.side, self.price, self.signal, self.at, self.ts = side, price, signal, at, ts
        self.allocated = self.cash * self.risk.position_size_pct
        self.units = self.allocated / price if price > 0 else 0.0
        self.cash -= self.allocated * (self.risk.fee_pct + self.risk.slippage_pct)

    def run(self, b: dict, final: bool) -> tuple[np.ndarray, np.ndarray, list[list[dict] | None]]:
        """Equity and position after each bar, and the trades that close on it."""
        n = len(b["close"])
        equity, position = np.empty(n), np.zeros(n, np.int32)
        trades: list[list[dict] | None] = [None] * n
        entries = np.flatnonzero(b["long_entry"] | b["short_entry"])
        k = 0
        while k < n:
            if not self.side:
                at = np.searchsorted(entries, k)
                to = int(entries[at]) if at < len(entries) else n
                equity[k:to] = self.cash
                if to == n:
                    break
                self.open(b, to)
                equity[to], position[to] = self.cash, self.side
                k = to + 1
                continue
            found = self.exit_bar(b, k, n)
            to = n if found is None else found
            value = self.units * (b["close"][k:to] - self.price) * self.side if self.price > 0 else 0.0
            equity[k:to], position[k:to] = self.cash + value, self.side
            if found is None:
                break
            trades[to] = [self.close(b, to, False)]
            equity[to] = self.cash
            if self.risk.allow_same_bar_reentry and (b["long_entry"][to] or b["short_entry"][to]):
                self.open(b, to)
                equity[to], position[to] = self.cash, self.side
            k = to + 1
        if final and self.side:
            trades[n - 1] = [*(trades[n - 1] or []), self.close(b, n - 1, True)]
            equity[n - 1] = self.cash
        return equity, position, trades
