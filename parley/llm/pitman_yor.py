"""Sampling and prediction of a hierarchical Pitman-Yor model with discount
one half.

A restaurant seats c customers of a dish at t tables. With all other seats
fixed, P(t) is proportional to S(c, t) g**t, where S is the generalised
Stirling number and g the mass of a new table: (strength + discount * tables of
the restaurant) * probability of the dish in the parent restaurant. For
discount 1/2 the Stirling numbers have a closed form, and
P(t + 1) / P(t) = 4 g (c - t) / (t (2 c - t - 1)),
so the tables of a dish are redrawn exactly (a blocked Gibbs step) by walking
outwards from the mode. All dishes are handled as arrays."""

from __future__ import annotations

import numpy as np

DISCOUNT = 0.5


def _ratio(c: np.ndarray, t: np.ndarray, g: np.ndarray) -> np.ndarray:
    """P(t + 1) / P(t)."""
    return 4 * g * (c - t) / (t * (2 * c - t - 1))


def _mode(c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The most probable t: the last with P(t) >= P(t - 1)."""
    b = 2 * c - 1 + 4 * g
    s = 8 * g * c / (b + np.sqrt(np.maximum(b * b - 16 * g * c, 0)))
    return np.clip(1 + np.floor(s), 1, c)


def _walk(c, g, mode, up: bool, rest=None, least: float = 1e-10):
    """Weights (relative to the mode's) on one side of the mode: their sum, or
    with ``rest`` the t at which the running sum passes it (0: not there)."""
    out = np.zeros(len(c))
    at, t, w = np.arange(len(c)), mode.copy(), np.ones(len(c))
    left = None if rest is None else rest.copy()
    while len(at):
        ok = t < c[at] if up else t > 1
        at, t, w = at[ok], t[ok], w[ok]
        left = None if left is None else left[ok]
        if not len(at):
            break
        if up:
            w = w * _ratio(c[at], t, g[at])
            t = t + 1
        else:
            t = t - 1
            w = w / _ratio(c[at], t, g[at])
        if left is None:
            out[at] += w
            ok = w > least
        else:
            left = left - w
            hit = left < 0
            out[at[hit]] = t[hit]
            ok = ~hit & (w > least)
            left = left[ok]
        at, t, w = at[ok], t[ok], w[ok]
    return out


def draw_tables(c: np.ndarray, g: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, from their exact conditional distribution."""
    t = np.ones(len(c), np.int64)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    cm, gm = c[many].astype(float), np.maximum(g[many].astype(float), 1e-300)
    mode = _mode(cm, gm)
    above, below = _walk(cm, gm, mode, True), _walk(cm, gm, mode, False)
    u = rng.random(len(many)) * (1 + above + below)
    got = mode.copy()
    side = np.flatnonzero((u >= 1) & (u < 1 + above))
    x = _walk(cm[side], gm[side], mode[side], True, u[side] - 1)
    got[side] = np.where(x > 0, x, mode[side])
    side = np.flatnonzero(u >= 1 + above)
    x = _walk(cm[side], gm[side], mode[side], False, u[side] - 1 - above[side])
    got[side] = np.where(x > 0, x, mode[side])
    t[many] = got
    return t


def predict(c, t, strength, customers, tables, parent):
    """Predictive probability of a dish with c customers at t tables."""
    return (c - DISCOUNT * t + (strength + DISCOUNT * tables) * parent) / (strength + customers)
