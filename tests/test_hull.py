from itertools import combinations

import numpy as np
import pytest

from massflow.operators.hull import least_norm_shares
from massflow.operators.solvers import subgradient


def by_faces(g):
    """The least norm over the hull, by every face's plane."""
    best = np.inf
    for k in range(1, len(g) + 1):
        for face in combinations(range(len(g)), k):
            part = g[list(face)]
            system = np.block([[part @ part.T, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            shares = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if shares.min() >= -1e-9 and abs(shares.sum() - 1) < 1e-9:
                best = min(best, float(np.linalg.norm(shares @ part)))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_least_norm_is_that_of_the_best_face(seed):
    draw = np.random.default_rng(seed)
    n, d = int(draw.integers(1, 8)), int(draw.integers(1, 6))
    g = draw.normal(size=(n, d)) + draw.choice([0.0, 0.5, 2.0]) * np.ones(d)
    if n > 2:
        g[1] = g[0]  # repeated gradients
    shares = least_norm_shares(g @ g.T)
    assert shares.min() >= 0 and shares.sum() == pytest.approx(1)
    assert np.linalg.norm(shares @ g) == pytest.approx(by_faces(g), abs=1e-6)


def test_gradients_that_vanish():
    assert least_norm_shares(np.zeros((3, 3))).sum() == 1


@pytest.mark.parametrize("memory", [3, 10])
def test_subgradient_descent_of_a_quadratic(memory):
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.normal(size=(20, 20)))[0]
    a = turn @ np.diag(np.geomspace(1, 30, 20)) @ turn.T
    a -= a.mean(1, keepdims=True)  # flat along equal shifts, as the transport objective
    a = a.T @ a / 30
    goal, calls = draw.normal(size=20), []

    def f(w):
        calls.append(1)
        g = a @ (w - goal)
        return float((w - goal) @ g / 2), g, None

    w = subgradient(f, np.zeros(20), lambda g, s: float(np.abs(g).max()) <= 1e-6, memory=memory)
    assert np.abs(a @ (w - goal)).max() <= 1e-6 and abs(w.mean()) < 1e-12
    assert len(calls) < 1500


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_subgradient_descent_arrives_for_any_draw(seed):
    draw = np.random.default_rng(seed)
    turn = np.linalg.qr(draw.normal(size=(20, 20)))[0]
    a = turn @ np.diag(np.geomspace(1, 30, 20)) @ turn.T
    a -= a.mean(1, keepdims=True)
    a = a.T @ a / 30
    goal, calls = draw.normal(size=20), []

    def f(w):
        calls.append(1)
        g = a @ (w - goal)
        return float((w - goal) @ g / 2), g, None

    w = subgradient(f, np.zeros(20), lambda g, s: float(np.abs(g).max()) <= 1e-6, memory=3)
    assert np.abs(a @ (w - goal)).max() <= 1e-6 and len(calls) < 1500
