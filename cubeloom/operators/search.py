"""Conjugate gradients and bounded quasi-Newton steps that look at many step lengths in one pass over the data.

A step costs a pass for the loss and gradient at its weights (none where the step before has made it on the same data), one for the losses and slopes of all trial
lengths along its direction, and one at the length that is taken. What is kept between steps (directions, pairs) are a few vectors of the weights' size, on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Trial lengths of a step, and the share of the first slope by which a loss must fall and to which a slope must have come down.
LENGTHS = tuple(2.0**k for k in range(3, -12, -1))
FALL, LEVEL = 1e-4, 0.9

At = Callable[[np.ndarray], tuple[float, np.ndarray]]
Along = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Search:
    """Steps of one kind, CG or LBFGS, with what they remember.

    low and high bound the weights (LBFGS alone): a weight at its bound stays there while the loss falls beyond it, and trial weights are cut to the bounds.
    """

    kind: str = "LBFGS"
    memory: int = 10
    low: np.ndarray | float | None = None
    high: np.ndarray | float | None = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    last: tuple[np.ndarray, np.ndarray] | None = None  # gradient and direction of the step before
    made: tuple[object, np.ndarray, float, np.ndarray] | None = None  # data, weights, loss and gradient of the last pass

    def __post_init__(self) -> None:
        if self.kind not in ("CG", "LBFGS"):
            raise ValueError("kind must be CG or LBFGS")
        if self.bounded and self.kind == "CG":
            raise ValueError("bounds need LBFGS")

    @property
    def bounded(self) -> bool:
        return self.low is not None or self.high is not None

    def cut(self, w: np.ndarray) -> np.ndarray:
        return np.clip(w, self.low, self.high) if self.bounded else w

    def _free(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        held = np.zeros(len(w), bool)
        if self.low is not None:
            held |= (w <= self.low) & (g > 0)
        if self.high is not None:
            held |= (w >= self.high) & (g < 0)
        return ~held

    def _direction(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.kind == "CG":
            if self.last is None:
                return -g
            before, d = self.last
            return -g + max(0.0, float(g @ (g - before)) / float(before @ before)) * d
        free = self._free(w, g)
        q, kept = g * free, []
        pairs = [(s * free, y * free) for s, y in self.pairs]
        pairs = [(s, y) for s, y in pairs if s @ y > 1e-10 * np.sqrt((s @ s) * (y @ y))]
        for s, y in reversed(pairs):
            kept.append((s @ q) / (s @ y))
            q = q - kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        return -q * free

    def step(self, at: At, along: Along, w: np.ndarray, data: object = None) -> tuple[np.ndarray, float]:
        """(weights, loss) after a step. at: loss and gradient at weights; along: losses, and gradients' products with the direction of the path, at each row of weights
        (rows, directions). data: what at and along read; the last pass is used again if it is the same."""
        w = self.cut(w)
        if self.made is not None and self.made[0] is data and np.array_equal(self.made[1], w):
            loss, g = self.made[2:]
        else:
            loss, g = at(w)
        d = self._direction(w, g)
        slope = float(g @ d)
        if slope >= 0:
            self.pairs, self.last = [], None
            d = -g * self._free(w, g)
            slope = float(g @ d)
        if slope == 0:
            return w, loss
        # The first step has no scale of its own: its longest trial moves the weights by about their own size.
        scale = 1.0 if self.pairs or self.last is not None else max(1.0, float(np.linalg.norm(w))) / float(np.linalg.norm(d))
        lengths = scale * np.array(LENGTHS)
        trials = np.stack([self.cut(w + t * d) for t in lengths])
        paths = np.stack([d * ((x == w + t * d) if self.bounded else 1.0) for t, x in zip(lengths, trials, strict=True)])
        losses, slopes = along(trials, paths)
        falls = np.isfinite(losses) & (losses <= loss + FALL * np.array([float(g @ (x - w)) for x in trials]))
        level = falls & (np.abs(slopes) <= LEVEL * abs(slope))
        best = np.flatnonzero(level if level.any() else falls)
        if not len(best):
            self.pairs, self.last, self.made = [], None, (data, w, loss, g)
            return w, loss
        k = int(best[np.argmin(losses[best])])
        new = trials[k]
        zero = self._zero(0.0, slope, lengths, slopes, k)
        taken = None
        if zero is not None:
            between = self.cut(w + zero * d)
            found = at(between)
            taken = (between, *found) if found[0] <= losses[k] else None
        if taken is None:
            taken = (new, *at(new))
        new, new_loss, new_g = taken
        s, y = new - w, new_g - g
        if s @ y > 1e-10 * np.sqrt((s @ s) * (y @ y)):  # else the curvature along the step says nothing of a minimum
            self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.last, self.made = (g, d), (data, new, new_loss, new_g)
        return new, new_loss

    def _zero(self, first: float, slope: float, lengths: np.ndarray, slopes: np.ndarray, k: int) -> float | None:
        """Where the slope passes 0 between the trials around the best one, taken as a straight line."""
        t = np.concatenate(([first], lengths[::-1]))
        v = np.concatenate(([slope], slopes[::-1]))
        at = len(lengths) - k
        for i in (at, at - 1):
            if 0 <= i < len(t) - 1 and np.isfinite(v[i + 1]) and v[i] < 0 < v[i + 1]:
                return float(t[i] - v[i] * (t[i + 1] - t[i]) / (v[i + 1] - v[i]))
        return None
