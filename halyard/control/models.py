"""Models: optimisers of storages, swings and plants over the engine of control.dp."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from halyard.control.dp import Optimizer, SwitchOptimizer
from halyard.control.grids import IntegerGrid


@dataclass
class Swing(Optimizer):
    """A number of rights to a payoff, one right a step at most; the stock is the number of rights used, in every coordinate of a fictitious product."""

    payoff: object
    rights: int
    regimes = 1
    controls = 1

    def _step(self, used, exercised, kept, x):
        now = self.payoff(x) + exercised
        able = used < self.rights
        use = able & (now > kept)
        return np.where(able, np.where(use, now, kept), 0.0), use

    def optimize(self, grid, stock, continuation, x, step, period=0):
        kept, used = continuation[0].at(x, stock), np.full(len(x), stock[0])
        after = continuation[0].at(x, np.minimum(stock + 1, self.rights)) if stock[0] < self.rights else kept
        value, use = self._step(used, after, kept, x)
        return value[:, None], use[:, None].astype(float)

    def simulate(self, continuation, regime, stock, x, step, period=0):
        kept, after = continuation[0].at(x, stock), continuation[0].at(x, np.minimum(stock + 1, self.rights))
        _, use = self._step(stock[:, 0], after, kept, x)
        return regime, stock + use[:, None], np.where(use, self.payoff(x), 0.0)

    def simulate_control(self, controls, regime, stock, x, step):
        use = (controls[0].at(x, stock) > 0.5) & (stock[:, 0] < self.rights)
        return regime, stock + use[:, None], np.where(use, self.payoff(x), 0.0)


@dataclass
class Storage(Optimizer):
    """A gas storage: nothing, the most in, or the most out; spot(x, step) is the price.

    With ``switch`` a change of the mode (0 idle, 1 in, 2 out) costs that much
    and the mode is the regime.
    """

    spot: object
    low: float
    high: float
    inject: float
    withdraw: float
    inject_cost: float = 0.35
    withdraw_cost: float = 0.35
    switch: float = 0.0
    regimes: int = 1
    controls: int = 1
    periods: int = 1

    def _moves(self, stock, x, step):
        """For each mode: (next stock, gain, able), rows or one stock."""
        s, n = self.spot(x, step), len(x)
        stock = np.broadcast_to(np.atleast_1d(stock), (n,)) if np.ndim(stock) < 1 or len(np.atleast_1d(stock)) != n else stock
        more, less = np.minimum(self.inject, self.high - stock), np.minimum(self.withdraw, stock - self.low)
        return [(stock, np.zeros(n), np.ones(n, bool)), (stock + more, -more * (s + self.inject_cost), more > 1e-9), (stock - less, less * (s - self.withdraw_cost), less > 1e-9)]

    def _candidates(self, stock, continuation, x, step):
        out = []
        for mode, (after, gain, able) in enumerate(self._moves(stock, x, step)):
            follow = continuation[min(mode, self.regimes - 1)].at(x, after[:, None])
            out.append(np.where(able, gain + follow, -1e30))
        return np.stack(out, 1)

    def optimize(self, grid, stock, continuation, x, step, period=0):
        worth = self._candidates(float(stock[0]), continuation, x, step)
        values, moved = [], None
        for regime in range(self.regimes):
            own = worth - (self.switch * (np.arange(3) != regime) if self.regimes > 1 else 0.0)
            values.append(own.max(1))
            if regime == 0:
                moves = self._moves(float(stock[0]), x, step)
                moved = np.choose(own.argmax(1), [m[0] for m in moves]) - stock[0]
        return np.stack(values, 1), moved[:, None]

    def simulate(self, continuation, regime, stock, x, step, period=0):
        worth = self._candidates(stock[:, 0], continuation, x, step)
        pay = self.switch * (np.arange(3)[None] != regime[:, None]) if self.regimes > 1 else np.zeros((len(x), 3))
        mode = (worth - pay).argmax(1)
        moves = self._moves(stock[:, 0], x, step)
        gain = np.choose(mode, [m[1] for m in moves]) - np.take_along_axis(pay, mode[:, None], 1)[:, 0]
        return (mode if self.regimes > 1 else regime), np.choose(mode, [m[0] for m in moves])[:, None], gain

    def simulate_control(self, controls, regime, stock, x, step):
        moved = np.clip(controls[0].at(x, stock), np.maximum(-self.withdraw, self.low - stock[:, 0]), np.minimum(self.inject, self.high - stock[:, 0]))
        s = self.spot(x, step)
        return regime, stock + moved[:, None], np.where(moved > 0, -moved * (s + self.inject_cost), -moved * (s - self.withdraw_cost))


def best_next(stock: np.ndarray, low: np.ndarray, high: np.ndarray, buy: np.ndarray, sell: np.ndarray, cuts: np.ndarray, halvings: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(next stock, slope there) that maximises, row by row, the concave gain + least of the cuts.

    Raising the stock costs ``buy`` a unit, lowering it earns ``sell`` a unit;
    cuts [row, cut, (intercept, slope)].  The slope of the sum falls, so its sign
    is halved down.
    """
    a, b = low.astype(float).copy(), high.astype(float).copy()
    rows = np.arange(len(a))
    for _ in range(halvings):
        m = (a + b) / 2
        active = (cuts[:, :, 0] + cuts[:, :, 1] * m[:, None]).argmin(1)
        rises = cuts[rows, active, 1] - np.where(m >= stock, buy, sell) > 0
        a, b = np.where(rises, m, a), np.where(rises, b, m)
    m = (a + b) / 2
    worth = lambda s: np.where(s >= stock, -buy * (s - stock), sell * (stock - s)) + (cuts[:, :, 0] + cuts[:, :, 1] * s[:, None]).min(1)
    tries = np.stack([m, low, high, np.clip(stock, low, high)], 1)
    best = np.stack([worth(tries[:, k]) for k in range(4)], 1).argmax(1)
    return tries[rows, best], cuts[rows, (cuts[:, :, 0] + cuts[:, :, 1] * m[:, None]).argmin(1), 1]


@dataclass
class StorageCut(Optimizer):
    """The storage with a concave value held as cuts: a step is a small linear programme, solved for all rows at once."""

    spot: object
    low: float
    high: float
    inject: float
    withdraw: float
    inject_cost: float = 0.35
    withdraw_cost: float = 0.35

    def _solve(self, stock, continuation, x, step):
        s, cuts = self.spot(x, step), continuation[0].cuts(x)
        low, high = np.maximum(self.low, stock - self.withdraw), np.minimum(self.high, stock + self.inject)
        after, _ = best_next(stock, low, high, s + self.inject_cost, s - self.withdraw_cost, cuts)
        gain = np.where(after >= stock, -(after - stock) * (s + self.inject_cost), (stock - after) * (s - self.withdraw_cost))
        return after, gain, gain + (cuts[:, :, 0] + cuts[:, :, 1] * after[:, None]).min(1)

    def optimize(self, grid, stock, continuation, x, step, period=0):
        here = np.full(len(x), stock[0])
        gap = 1e-4 * (self.high - self.low)
        value = self._solve(here, continuation, x, step)[2]
        # a slope of the value itself: one-sided at the ends of the box
        up, down = np.minimum(here + gap, self.high), np.maximum(here - gap, self.low)
        slope = (self._solve(up, continuation, x, step)[2] - self._solve(down, continuation, x, step)[2]) / (up - down)
        return np.stack([value, slope], 1), None

    def simulate(self, continuation, regime, stock, x, step, period=0):
        after, gain, _ = self._solve(stock[:, 0], continuation, x, step)
        return regime, after[:, None], gain


@dataclass
class Lake(Optimizer):
    """A lake with random inflow x[:, 0]: keep, or withdraw the most, at a price that depends on the step."""

    price: object
    high: float
    withdraw: float
    controls = 1

    def _moves(self, stock, x, step):
        filled = np.minimum(stock + np.maximum(x[:, 0], 0), self.high)
        out = np.minimum(self.withdraw, filled)
        return [(filled, np.zeros(len(x))), (filled - out, out * self.price(step))]

    def optimize(self, grid, stock, continuation, x, step, period=0):
        moves = self._moves(np.full(len(x), stock[0]), x, step)
        worth = np.stack([g + continuation[0].at(x, s[:, None]) for s, g in moves], 1)
        return worth.max(1)[:, None], worth.argmax(1)[:, None].astype(float)

    def simulate(self, continuation, regime, stock, x, step, period=0):
        moves = self._moves(stock[:, 0], x, step)
        take = np.stack([g + continuation[0].at(x, s[:, None]) for s, g in moves], 1).argmax(1)
        return regime, np.choose(take, [m[0] for m in moves])[:, None], np.choose(take, [m[1] for m in moves])

    def simulate_control(self, controls, regime, stock, x, step):
        moves = self._moves(stock[:, 0], x, step)
        take = (controls[0].at(x, stock) > 0.5).astype(int)
        return regime, np.choose(take, [m[0] for m in moves])[:, None], np.choose(take, [m[1] for m in moves])


@dataclass
class Thermal(SwitchOptimizer):
    """A plant, on (regime 0) or off (1), that must stay so for some steps; the state counts steps since the switch."""

    margin: object
    least_on: int
    least_off: int
    cost: float
    grids: list = field(init=False)

    def __post_init__(self):
        self.grids = [IntegerGrid([0], [self.least_on - 1]), IntegerGrid([0], [self.least_off - 1])]

    def _choices(self, regime, state, continuation, x, step):
        least = (self.least_on, self.least_off)[regime]
        gain = self.margin(x, step) if regime == 0 else np.zeros(len(x))
        stay = gain + np.take_along_axis(continuation[regime], np.minimum(state + 1, least - 1)[:, None], 1)[:, 0]
        start = self.cost if regime == 1 else 0.0
        turn_gain = self.margin(x, step) if regime == 1 else np.zeros(len(x))
        turn = np.where(state >= least - 1, turn_gain - start + continuation[1 - regime][:, 0], -np.inf)
        return stay, turn, gain, turn_gain - start

    def optimize(self, regime, state, continuation, x, step):
        stay, turn, _, _ = self._choices(regime, np.full(len(x), state[0]), continuation, x, step)
        return np.maximum(stay, turn)

    def simulate(self, regime, state, continuation, x, step):
        stay, turn, keep, move = self._choices(regime, state[:, 0], continuation, x, step)
        switch, least = turn > stay, (self.least_on, self.least_off)[regime]
        return np.where(switch, 1 - regime, regime), np.where(switch, 0, np.minimum(state[:, 0] + 1, least - 1))[:, None], np.where(switch, move, keep)
