"""Numpy helpers for one short daily series (at most one year): robust fits of all history prefixes at once.

Row ``i`` of every mask or result stands for one forecast origin, so a rolling back-test is a few matrix operations.
"""

from __future__ import annotations

import numpy as np

MODELS = ("last_value", "median", "linear", "huber", "damped", "state_space_local_linear")
HUBER_DELTA, HUBER_ROUNDS = 1.345, 25
DAMPING, DAMPED_POINTS = 0.88, 5
STATE_DAMPING, EARLY_GAIN, LATE_GAIN, SLOPE_GAIN, CLIP = 0.90, 0.20, 0.32, 0.06, 3.0


def lines(x, y, w):
    """Weighted least-squares slope and intercept per row of ``w``."""
    total = np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    mx, my = (w * x).sum(axis=1, keepdims=True) / total, (w * y).sum(axis=1, keepdims=True) / total
    dx = x - mx
    sxx = (w * dx * dx).sum(axis=1)
    slope = np.divide((w * dx * (y - my)).sum(axis=1), sxx, out=np.zeros_like(sxx), where=sxx > 0)
    return slope, my[:, 0] - slope * mx[:, 0]


def row_median(values, mask):
    """Median of the masked entries per row; every row has at least one."""
    ordered, n = np.sort(np.where(mask, values, np.inf), axis=1), mask.sum(axis=1)
    rows = np.arange(len(n))
    return (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2.0


def huber_lines(x, y, mask):
    """Iteratively reweighted lines; the residual scale stays that of the first fit. Rounds end early once no row changes."""
    slope, icpt = lines(x, y, mask.astype(float))
    first = np.abs(y - (slope[:, None] * x + icpt[:, None]))
    limit = HUBER_DELTA * np.maximum(1.4826 * row_median(first, mask), 1e-9)[:, None]
    for _ in range(HUBER_ROUNDS):
        away = np.abs(y - (slope[:, None] * x + icpt[:, None]))
        weights = mask * np.where(away > limit, limit / np.maximum(away, 1e-300), 1.0)
        before, (slope, icpt) = (slope, icpt), lines(x, y, weights)
        if np.array_equal(slope, before[0]) and np.array_equal(icpt, before[1]):
            break
    return slope, icpt


def state_filter(x, y, ends):
    """Local level and slope after each prefix; innovations are clipped at three noise levels."""
    steps = np.maximum(np.diff(x), 1e-6)
    rates = np.diff(y) / steps
    known = np.arange(len(y))[None, :] < ends[:, None]
    middle = row_median(y[None, :], known)
    noise = np.maximum(1.4826 * row_median(np.abs(y[None, :] - middle[:, None]), known), 1e-3)
    back = ends[:, None] - 2 - np.arange(len(rates))[None, :]
    slope = row_median(rates[None, :], (back >= 0) & (back < 7)) if len(rates) else np.zeros(len(ends))
    level = np.full(len(ends), y[0], dtype=float)
    for i in range(1, int(max(ends))):
        on = ends > i
        guess = level + slope * steps[i - 1]
        surprise = np.clip(y[i] - guess, -CLIP * noise, CLIP * noise)
        gain = np.where(i < ends - 7, EARLY_GAIN, LATE_GAIN)
        level = np.where(on, guess + gain * surprise, level)
        slope = np.where(on, (1 - SLOPE_GAIN) * slope + SLOPE_GAIN * surprise / steps[i - 1], slope)
    return level, slope


def damped_sum(rate, lead):
    return (1.0 - rate**lead) / (1.0 - rate)


def predict(x, y, ends, rows, targets):
    """Predictions of every model: entry j belongs to prefix ``ends[rows[j]]`` and day ``targets[j]``."""
    position = np.arange(len(x))
    mask = position[None, :] < ends[:, None]
    last_x, last_y = x[ends - 1], y[ends - 1]
    lead = targets - last_x[rows]
    middle = row_median(np.broadcast_to(y, mask.shape), mask)
    straight = lines(x, y, mask.astype(float))
    both = huber_lines(x, y, np.concatenate([mask, mask & (position[None, :] >= ends[:, None] - DAMPED_POINTS)]))  # rows do not depend on each other
    robust, near = [v[:len(ends)] for v in both], both[0][len(ends):]
    level, pace = state_filter(x, y, ends)
    return {
        "last_value": last_y[rows],
        "median": middle[rows],
        "linear": straight[0][rows] * targets + straight[1][rows],
        "huber": robust[0][rows] * targets + robust[1][rows],
        "damped": last_y[rows] + near[rows] * damped_sum(DAMPING, lead),
        "state_space_local_linear": level[rows] + pace[rows] * damped_sum(STATE_DAMPING, lead),
    }


def rolling_origins(x, y, reach=7.0, share=0.45, least=8):
    """Back-test of all models: expanding history, targets within ``reach`` days after each origin."""
    ends = np.arange(max(least, int(np.ceil(len(y) * share))), len(y))
    pairs = [(i, j) for i, e in enumerate(ends) for j in range(e, len(x)) if x[j] <= x[e - 1] + reach + 1e-9]
    if not pairs:
        return None
    rows, cols = (np.array(v) for v in zip(*pairs))
    return x[cols] - x[ends[rows] - 1], y[cols], predict(x, y, ends, rows, x[cols])


def local_smooth(x, y, span=0.45, rounds=3):
    """Tricube-weighted local lines through the nearest ``span`` of points, made robust by reweighting."""
    q = max(3, min(len(x), int(np.ceil(len(x) * span))))
    distance = np.abs(x[:, None] - x[None, :])
    near = np.argsort(distance, axis=1, kind="stable")[:, :q]
    d, lx, ly = np.take_along_axis(distance, near, axis=1), x[near], y[near]
    width = np.maximum(d[:, -1:], 1e-9)
    base = np.where(d < width, (1.0 - np.minimum(d / width, 1.0) ** 3) ** 3, 0.0)
    extra = np.ones_like(base)
    for _ in range(rounds):
        slope, icpt = lines(lx, ly, np.maximum(base * extra, 1e-12))
        away = np.abs(ly - (slope[:, None] * lx + icpt[:, None]))
        cut = HUBER_DELTA * np.maximum(1.4826 * np.median(away, axis=1), 1e-9)[:, None]
        extra = np.where(away <= cut, 1.0, cut / np.maximum(away, 1e-12))
    return slope * x + icpt


def trend_fit(x, y, share=0.30):
    """Robust slope and intercept of the whole series, residual spread, and robust slope of the recent part."""
    everything = np.ones((1, len(x)), dtype=bool)
    recent = np.arange(len(x))[None, :] >= len(x) - max(3, int(np.ceil(len(x) * share)))
    slope, icpt = huber_lines(x, y, np.concatenate([everything, recent]))  # rows do not depend on each other
    return slope[0], icpt[0], float(np.std(y - (slope[0] * x + icpt[0]))), slope[1]
