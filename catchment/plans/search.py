"""A bounded quasi-Newton search whose points are scored in batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distance of the points from which slopes are taken, and pairs of steps and slope changes that are remembered.
STEP, MEMORY = 1e-3, 8
#: Shares of a step that are tried together.
SHARES = (1.0, 0.4, 0.1, 0.02)


def slopes(values: Callable[[list[np.ndarray]], np.ndarray], x: np.ndarray) -> np.ndarray:
    """The gradient at x by points on either side (on one at a bound), all scored in one batch."""
    n = len(x)
    high, low = [np.clip(x + STEP * e, 0, 1) for e in np.eye(n)], [np.clip(x - STEP * e, 0, 1) for e in np.eye(n)]
    found = values(high + low)
    return (found[:n] - found[n:]) / np.array([h[i] - lo[i] for i, (h, lo) in enumerate(zip(high, low, strict=True))])


def direction(gradient: np.ndarray, free: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton step within the free coordinates, by the two loops over the remembered pairs."""
    d, kept = np.where(free, -gradient, 0.0), []
    for s, y in reversed(pairs):
        s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
        if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y) > 0:
            a = s @ d / (s @ y)
            d = d - a * y
            kept.append((s, y, a))
    if kept:
        s, y, _ = kept[0]
        d = d * (s @ y) / (y @ y)
    for s, y, a in reversed(kept):
        d = d + s * (a - y @ d / (s @ y))
    return np.where(free, d, 0.0)


def minimize(values: Callable[[list[np.ndarray]], np.ndarray], start: np.ndarray, most: int = 200, longest: float = 0.3, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    """(a point of the unit cube with a locally least value, points scored): limited-memory curvature with projection on the bounds.

    values scores a list of points at once (infinite: not usable), so that a round is two batches: the slopes at a point, and several lengths of the step from it.
    At most `most` points are scored; no step is longer than `longest` in any coordinate.
    """
    x = np.clip(np.asarray(start, dtype=float), 0, 1)
    best, spent = values([x])[0], 1
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    before: tuple[np.ndarray, np.ndarray] | None = None
    round_ = 2 * len(x) + len(SHARES)
    while np.isfinite(best) and spent + round_ <= most:
        g = slopes(values, x)
        spent += 2 * len(x)
        if not np.isfinite(g).all():
            break
        if before is not None:
            pairs = [*pairs, (x - before[0], g - before[1])][-MEMORY:]
        free = ~(((x <= 0) & (g > 0)) | ((x >= 1) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tolerance:
            break
        d = direction(g, free, pairs)
        if d @ g >= 0:
            pairs, d = [], np.where(free, -g, 0.0)
        size = np.abs(d).max()
        d = d * (longest / size if size > longest or not pairs else 1.0)
        tried = [np.clip(x + t * d, 0, 1) for t in SHARES]
        found = values(tried)
        spent += len(SHARES)
        k = int(np.argmin(found))
        if not found[k] < best:
            if not pairs:
                longest /= 10
                if longest < 1e-4:
                    break
            pairs, before = [], None
            continue
        before = x, g
        small = best - found[k] < 1e-8 * (abs(best) + 1)
        x, best = tried[k], found[k]
        if small:
            break
    return x, spent
