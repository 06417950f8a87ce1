"""A plain sequential filter and smoother, one series at a time, that the tests hold the Spark operators against."""

from __future__ import annotations

import numpy as np

H = np.array([[1.0, 0, 0], [0, 0, 1.0]])


def model(dt, q, c):
    f = np.eye(3)
    f[0, 1], f[0, 2] = c * dt, -c * dt
    a = np.array([[0, c, -c], [0, 0, 0], [0, 0, 0.0]])
    return f, q * dt + (a @ q + q @ a.T) * dt**2 / 2 + a @ q @ a.T * dt**3 / 3


def kept(rows):
    """rows: sorted [(us, storage, outflow)] with NaN; the indexes of filter steps."""
    seen = [i for i, r in enumerate(rows) if np.isfinite(r[1])]
    return [seen[0], *range(seen[1], len(rows))] if len(seen) > 1 else []


def run(rows, config):
    """[(index, m, P, m before, P before, F)] of one series."""
    q, r, c = np.array(config.q), np.array(config.r), config.units.flow_to_volume_per_second
    out, before = [], None
    for i in kept(rows):
        us, *y = rows[i]
        y = np.array(y)
        if before is None:
            m, p = np.array([y[0], y[1], y[1]]), np.array(config.p0)
            f, noise = np.eye(3), np.zeros((3, 3))
        else:
            f, noise = model((us - before) / 1e6, q, c)
        before = us
        bm, bp = f @ m, f @ p @ f.T + noise
        see = np.isfinite(y)
        m, p = bm, bp
        if see.any():
            h = H[see]
            s = h @ bp @ h.T + r[np.ix_(see, see)]
            k = np.linalg.solve(s, h @ bp).T
            m = bm + k @ (y[see] - h @ bm)
            rest = np.eye(3) - k @ h
            p = rest @ bp @ rest.T + k @ r[np.ix_(see, see)] @ k.T
        out.append((i, m, p, bm, bp, f))
    return out


def revise(rows, steps, lag_us):
    """{index: (mean, covariance)} of the rows that are released."""
    out = {}
    for k, (i, *_) in enumerate(steps):
        j = next((n for n in range(k, len(steps)) if rows[steps[n][0]][0] - rows[i][0] >= lag_us), None)
        if j is None:
            continue
        out[i] = back(steps, k, j)
    return out


def back(steps, k, j):
    m, p = steps[j][1], steps[j][2]
    for n in range(j - 1, k - 1, -1):
        _, _, _, bm, bp, f = steps[n + 1]
        g = np.linalg.solve(bp, f @ steps[n][2]).T
        m = steps[n][1] + g @ (m - bm)
        p = steps[n][2] + g @ (p - bp) @ g.T
    return m, p
