"""Step lengths along a direction that lowers a convex objective.

An evaluation is a Spark job over all cells, so a search is judged by how few it
needs; what is done here is a handful of numbers an evaluation. The conditions
that a step must meet are a parameter:

* ``armijo``: f falls by at least ``FALL`` of what the slope promises;
* ``wolfe``: and the slope has risen to at least ``FLAT`` of the first one;
* ``strong-wolfe``: and is no steeper upwards than that.

``backtracked`` halves and stretches the step until they are met; ``interpolated``
meets the last by safeguarded cubic and quadratic interpolation in an interval that holds such a
step (Moré and Thuente, ACM TOMS 20, 1994); ``searched`` takes the second where it ends well,
else the first. Each returns None where no step lowers f as it should.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

# Fixed values of the surveyed searches.
FALL, FLAT, SHORTER, LONGER, TRIES = 1e-4, 0.9, 0.5, 2.1, 20
SHORTEST, LONGEST = 1e-20, 1e20
CONDITIONS = ("armijo", "wolfe", "strong-wolfe")


@dataclass(frozen=True)
class Trial:
    """A step's length, value and slope, and what else its evaluation gave."""

    t: float
    f: float
    slope: float
    found: tuple = ()

    def falls(self, start: Trial) -> bool:
        return self.f <= start.f + FALL * self.t * start.slope

    def meets(self, start: Trial, conditions: str) -> bool:
        if not self.falls(start) or conditions == "armijo":
            return self.falls(start)
        return self.slope >= FLAT * start.slope and (conditions == "wolfe" or self.slope <= -FLAT * start.slope)

    def less(self, start: Trial) -> Trial:
        """As a trial of f less the fall that is asked for."""
        return Trial(self.t, self.f - FALL * self.t * start.slope, self.slope - FALL * start.slope, self.found)


Along = Callable[[float], Trial]


def backtracked(along: Along, start: Trial, t: float, conditions: str = "strong-wolfe", tries: int = TRIES) -> Trial | None:
    """The step halved while it is too long and stretched while too short; of ended searches the last that lowered f enough."""
    if conditions not in CONDITIONS:
        raise ValueError(f"no such conditions: {conditions}")
    best = None
    for _ in range(tries):
        got = along(t)
        if got.falls(start):
            best = got
            if got.meets(start, conditions):
                return got
        t *= LONGER if best is got and got.slope < FLAT * start.slope else SHORTER
        if not SHORTEST < t < LONGEST:
            break
    return best


def _cubic(a: Trial, b: Trial) -> float | None:
    """Where the cubic through two trials' values and slopes is least, if it is."""
    if a.t == b.t:
        return None
    m = a.slope + b.slope - 3 * (a.f - b.f) / (a.t - b.t)
    under = m * m - a.slope * b.slope
    if not under >= 0:
        return None
    root = math.copysign(math.sqrt(under), b.t - a.t)
    rise = b.slope - a.slope + 2 * root
    return b.t - (b.t - a.t) * (b.slope + root - m) / rise if rise else None


def _secant(a: Trial, b: Trial) -> float | None:
    """Where the slope between two trials vanishes."""
    return b.t - b.slope * (b.t - a.t) / (b.slope - a.slope) if b.slope != a.slope else None


def _next(best: Trial, end: Trial | None, got: Trial, low: float, high: float) -> float:
    """The next step's length; ``end`` bounds the interval on the other side of ``best``, if one does."""
    cubic = _cubic(best, got)
    if got.f > best.f:  # a minimum lies between them: the cubic's, or midway to the parabola's
        width = got.t - best.t
        drop = (best.f - got.f) / width + best.slope
        parabola = best.t + best.slope / drop / 2 * width
        if cubic is None:
            return parabola
        return cubic if abs(cubic - best.t) < abs(parabola - best.t) else (cubic + parabola) / 2
    line = _secant(best, got)
    if got.slope * best.slope < 0:  # likewise, by the slopes: the one further from the trial
        return cubic if cubic is not None and abs(cubic - got.t) >= abs(line - got.t) else line
    ahead = high if got.t > best.t else low
    if abs(got.slope) < abs(best.slope):  # the slope flattens: the minimum lies ahead, if anywhere
        if cubic is None or (cubic - got.t) * (got.t - best.t) <= 0:
            cubic = ahead
        if end is None:
            return max(low, min(high, cubic if abs(cubic - got.t) > abs(line - got.t) else line))
        near = cubic if abs(cubic - got.t) < abs(line - got.t) else line
        bound = got.t + 0.66 * (end.t - got.t)
        return min(near, bound) if got.t > best.t else max(near, bound)
    between = _cubic(got, end) if end is not None else ahead
    return ahead if between is None else between


def interpolated(along: Along, start: Trial, t: float, tries: int = TRIES) -> Trial | None:
    """A step that meets the strong Wolfe conditions, by interpolation; None where the tries end before."""
    best, end, shaped = start, None, True
    width, before = math.inf, math.inf
    low, high = 0.0, 5 * t
    for _ in range(tries):
        got = along(t)
        if got.meets(start, "strong-wolfe"):
            return got
        # until a step fell enough and the slope turned, the interval is that of f less the asked fall
        shaped = shaped and not (got.falls(start) and got.slope >= 0)
        view = (lambda x: x.less(start)) if shaped and got.f <= best.f and not got.falls(start) else lambda x: x
        b, g = view(best), view(got)
        t = _next(b, view(end) if end else None, g, low, high)
        if g.f > b.f:
            end = got
        else:
            if g.slope * b.slope < 0:
                end = best
            best = got
        if end is None:
            low, high = t + 1.1 * (t - best.t), t + 4 * (t - best.t)
        else:
            if abs(end.t - best.t) >= 0.66 * before:
                t = best.t + (end.t - best.t) / 2
            before, width = width, abs(end.t - best.t)
            low, high = min(best.t, end.t), max(best.t, end.t)
            t = max(low, min(high, t))
            if high - low <= 1e-15 * high:
                break
        t = max(SHORTEST, min(LONGEST, t))
    return None


def searched(along: Along, start: Trial, t: float) -> Trial | None:
    """By interpolation, else by halving and stretching."""
    if not start.slope < 0:
        return None
    return interpolated(along, start, t) or backtracked(along, start, t)
