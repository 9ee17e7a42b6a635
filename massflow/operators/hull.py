"""The point of least norm in the hull of a few gradients, by an active set.

A face of the hull is kept whose plane's nearest point to the origin lies inside it. A gradient
that lies on the origin's side of the plane through that point joins the face; where the new
plane's nearest point is outside, the step towards it stops at the border and the gradient whose
share becomes 0 leaves (Wolfe, Mathematical Programming 11, 1976). Only the gradients' products
are looked at, so a call costs their number cubed, whatever the number of sites.
"""

from __future__ import annotations

import numpy as np


def _plane(products: np.ndarray) -> np.ndarray:
    """Shares, of any sign and sum 1, of the point of least norm in the plane through some gradients."""
    k = len(products)
    system = np.ones((k + 1, k + 1))
    system[:k, :k], system[k, k] = products, 0.0
    return np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]


def least_norm_shares(products: np.ndarray, eps: float = 1e-12, max_steps: int = 1000) -> np.ndarray:
    """Shares, none negative and of sum 1, of the point of least norm; ``products`` are those of each two gradients."""
    n = len(products)
    scale = float(np.trace(products)) / n
    shares = np.zeros(n)
    if scale <= 0:  # they are all 0
        shares[-1] = 1.0
        return shares
    a = products / scale
    face = [int(np.argmin(np.diag(a)))]
    shares[face] = 1.0
    for _ in range(max_steps):
        along = a @ shares
        new = int(np.argmin(along))
        if new in face or along[new] >= shares @ along - eps:
            break
        face.append(new)
        while True:
            goal = _plane(a[np.ix_(face, face)])
            now = shares[face]
            if (goal > 0).all():
                shares[face] = goal
                break
            out = goal <= 0
            t = float(np.min(now[out] / np.maximum(now[out] - goal[out], 1e-300)))
            moved = now + min(1.0, t) * (goal - now)
            left = out & (moved <= 1e-14)
            if not left.any():
                left[int(np.argmin(np.where(out, moved, np.inf)))] = True
            shares[face] = np.where(left, 0.0, moved)
            face = [i for i, gone in zip(face, left, strict=True) if not gone]
            if len(face) == 1:
                shares[:] = 0.0
                shares[face] = 1.0
                break
    return shares / shares.sum()
