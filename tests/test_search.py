import math
from functools import partial

import pytest

from massflow.operators import search
from massflow.operators.search import Trial

#: Functions along a line with their slopes, which fall at 0: one long flat, one steep at its end, a parabola, one with many turns.
LINES = {
    "flat": (lambda t: -t / (t * t + 2), lambda t: (t * t - 2) / (t * t + 2) ** 2),
    "steep": (lambda t: (t + 0.004) ** 5 - 2 * (t + 0.004) ** 4, lambda t: 5 * (t + 0.004) ** 4 - 8 * (t + 0.004) ** 3),
    "parabola": (lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3)),
    "bumpy": (lambda t: 0.05 * (t - 9) ** 2 - 0.2 * math.sin(5 * t), lambda t: 0.1 * (t - 9) - math.cos(5 * t)),
    "kinked": (lambda t: abs(t - 2) + 0.1 * t * t, lambda t: (1 if t > 2 else -1) + 0.2 * t),
}


def line(name):
    f, slope = LINES[name]
    asked = []

    def along(t):
        asked.append(t)
        return Trial(t, f(t), slope(t), (t,))

    return along, Trial(0.0, f(0.0), slope(0.0)), asked


@pytest.mark.parametrize("first", [1e-3, 0.1, 1.0, 10.0, 1000.0])
@pytest.mark.parametrize("name", sorted(LINES))
def test_steps_meet_the_conditions_asked_for(name, first):
    along, start, asked = line(name)
    if start.slope >= 0:
        pytest.skip("doesn't fall at 0")
    for conditions in search.CONDITIONS:
        got = search.backtracked(along, start, first, conditions, tries=60)
        if (name, conditions) not in {("kinked", "strong-wolfe"), ("bumpy", "strong-wolfe"), ("steep", "strong-wolfe")}:
            assert got.meets(start, conditions)
    asked.clear()
    got = search.searched(along, start, first)
    assert got.falls(start) and got.found == (got.t,)
    if name != "kinked":
        assert got.meets(start, "strong-wolfe") and len(asked) <= search.TRIES


def test_interpolation_needs_fewer_trials():
    spent = {}
    for find in (search.interpolated, search.backtracked):
        for name in ("flat", "steep", "parabola"):
            for first in (1e-3, 0.1, 10.0, 1000.0):
                along, start, asked = line(name)
                find(along, start, first)
                spent[find.__name__] = spent.get(find.__name__, 0) + len(asked)
    assert spent["interpolated"] < spent["backtracked"]


def test_searches_that_find_nothing():
    up = lambda t: Trial(t, t, 1.0)
    assert search.searched(up, Trial(0.0, 0.0, 1.0), 1.0) is None
    rises = lambda t: Trial(t, 1.0, -1.0)
    assert search.searched(rises, Trial(0.0, 0.0, -1.0), 1.0) is None
    broken = lambda t: Trial(t, math.inf, math.nan)
    assert search.backtracked(broken, Trial(0.0, 0.0, -1.0), 1.0) is None
    with pytest.raises(ValueError):
        search.backtracked(up, Trial(0.0, 0.0, -1.0), 1.0, "none")
    assert partial(search.backtracked, conditions="armijo")(line("parabola")[0], line("parabola")[1], 1.0).t == 1.0
