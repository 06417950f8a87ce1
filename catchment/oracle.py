"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

# The observation view: see queries.event_observations.
OBS = """
e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events),
s AS (SELECT CAST(user_id AS VARCHAR) AS series, us, event_type, value,
        CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE 1000 + value / 10 END AS storage FROM e WHERE rn = 1),
n AS (SELECT *, count(storage) OVER (PARTITION BY series ORDER BY us) AS nfs FROM s),
obs AS (SELECT series, us, storage, CASE WHEN event_type = 'error' OR (event_type = 'signup' AND nfs >= 3) THEN NULL ELSE value END AS outflow FROM n)
"""

STEPS = """
f AS (SELECT series, min(us) AS first_us FROM obs WHERE storage IS NOT NULL GROUP BY series),
g AS (SELECT obs.series, min(us) AS second_us FROM obs JOIN f USING (series) WHERE storage IS NOT NULL AND us > first_us GROUP BY obs.series),
h AS (SELECT obs.*, first_us, second_us FROM obs JOIN f USING (series) JOIN g USING (series) WHERE us = first_us OR us >= second_us),
steps AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS dt, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY series ORDER BY us))
"""

PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _p(i: int, j: int, prefix: str) -> str:
    return f"{prefix}{min(i, j)}{max(i, j)}"


def _update(source: str, r: tuple[float, float]) -> str:
    """SQL over rows with bm0 .. bp22, storage and outflow that adds innovations, gains and the state after the reading."""
    seen = "(storage IS NOT NULL)", "(outflow IS NOT NULL)"
    keep = "series, n, us, dt, storage, outflow, first_us, second_us, bm0, bm1, bm2, " + ", ".join(_p(i, j, "bp") for i, j in PAIRS)
    inner = f"""SELECT {keep}, storage - bm0 AS v0, outflow - bm2 AS v1, bp00 + {r[0]} AS s00, bp02 AS s01, bp22 + {r[1]} AS s11 FROM ({source})"""
    inverse = f"""SELECT *, CASE WHEN {seen[0]} AND {seen[1]} THEN s11 / (s00 * s11 - s01 * s01) WHEN {seen[0]} THEN 1 / s00 ELSE CAST(0 AS DOUBLE) END AS i00,
      CASE WHEN {seen[0]} AND {seen[1]} THEN -s01 / (s00 * s11 - s01 * s01) ELSE CAST(0 AS DOUBLE) END AS i01,
      CASE WHEN {seen[0]} AND {seen[1]} THEN s00 / (s00 * s11 - s01 * s01) WHEN {seen[1]} THEN 1 / s11 ELSE CAST(0 AS DOUBLE) END AS i11 FROM ({inner})"""
    gains = ", ".join(f"{_p(a, 0, 'bp')} * i0{c} + {_p(a, 2, 'bp')} * i{'01' if c == 0 else '11'} AS k{a}{c}" for a in range(3) for c in range(2))
    gained = f"SELECT *, {gains} FROM ({inverse})"
    means = ", ".join(f"bm{a} + k{a}0 * coalesce(v0, 0) + k{a}1 * coalesce(v1, 0) AS m{a}" for a in range(3))
    covs = ", ".join(f"{_p(a, b, 'bp')} - k{a}0 * {_p(0, b, 'bp')} - k{a}1 * {_p(2, b, 'bp')} AS {_p(a, b, 'p')}" for a, b in PAIRS)
    return f"SELECT {keep}, v0, v1, s00, s01, s11, {means}, {covs} FROM ({gained})"


def filter_sql(q: tuple, r: tuple, p0: tuple, c: str) -> str:
    """CTEs obs, steps and rec: the filter as one recursion over step numbers, for diagonal noise."""
    state = "m0, m1, m2, " + ", ".join(_p(i, j, "p") for i, j in PAIRS)
    start = "SELECT series, n, us, CAST(0 AS DOUBLE) AS dt, storage, outflow, first_us, second_us, storage AS bm0, outflow AS bm1, outflow AS bm2, " + ", ".join(
        f"CAST({p0[i] if i == j else 0} AS DOUBLE) AS bp{i}{j}" for i, j in PAIRS
    ) + " FROM steps WHERE n = 1"
    row = [f"({_p(0, b, 'p')} + cd * {_p(1, b, 'p')} - cd * {_p(2, b, 'p')})" for b in range(3)]
    noise = {
        (0, 0): f"{q[0]} * d + {c} * {c} * ({q[1]} + {q[2]}) * d * d * d / 3",
        (0, 1): f"{c} * {q[1]} * d * d / 2",
        (0, 2): f"-({c} * {q[2]} * d * d / 2)",
        (1, 1): f"{q[1]} * d",
        (1, 2): "0",
        (2, 2): f"{q[2]} * d",
    }
    moved = {(0, 0): f"{row[0]} + cd * {row[1]} - cd * {row[2]}", (0, 1): row[1], (0, 2): row[2], (1, 1): "p11", (1, 2): "p12", (2, 2): "p22"}
    joined = f"SELECT t.series, t.n, t.us, t.dt, t.storage, t.outflow, t.first_us, t.second_us, t.dt AS d, {c} * t.dt AS cd, {state} FROM rec JOIN steps t ON t.series = rec.series AND t.n = rec.n + 1"
    predict = f"SELECT series, n, us, dt, storage, outflow, first_us, second_us, m0 + cd * (m1 - m2) AS bm0, m1 AS bm1, m2 AS bm2, " + ", ".join(
        f"{moved[k]} + {noise[k]} AS bp{k[0]}{k[1]}" for k in PAIRS
    ) + f" FROM ({joined})"
    return f"{OBS}, {STEPS}, rec AS ({_update(start, r)} UNION ALL {_update(predict, r)})"


def _inverse(prefix: str) -> str:
    """Entries w00 .. w22 of the inverse of a symmetric matrix with entries prefix00 .. prefix22."""
    x = lambda i, j: _p(i, j, prefix)
    minor = lambda a, b, c, d: f"({a} * {d} - {b} * {c})"
    det = f"({x(0, 0)} * {minor(x(1, 1), x(1, 2), x(1, 2), x(2, 2))} - {x(0, 1)} * {minor(x(0, 1), x(1, 2), x(0, 2), x(2, 2))} + {x(0, 2)} * {minor(x(0, 1), x(1, 1), x(0, 2), x(1, 2))})"
    cof = {
        (0, 0): minor(x(1, 1), x(1, 2), x(1, 2), x(2, 2)),
        (0, 1): f"-{minor(x(0, 1), x(1, 2), x(0, 2), x(2, 2))}",
        (0, 2): minor(x(0, 1), x(1, 1), x(0, 2), x(1, 2)),
        (1, 1): minor(x(0, 0), x(0, 2), x(0, 2), x(2, 2)),
        (1, 2): f"-{minor(x(0, 0), x(0, 1), x(0, 2), x(1, 2))}",
        (2, 2): minor(x(0, 0), x(0, 1), x(0, 1), x(1, 1)),
    }
    return ", ".join(f"{v} / {det} AS w{i}{j}" for (i, j), v in cof.items())


def _gains(c: str) -> str:
    """Rows of rec but each series' last, with the gains g00 .. g22 and the state predicted for the row behind (nbm, nbp)."""
    move = [["1", "cd", "-cd"], ["0", "1", "0"], ["0", "0", "1"]]
    pf = lambda a, b: "(" + " + ".join(f"{_p(a, x, 'p')} * ({move[b][x]})" for x in range(3)) + ")"
    gain = ", ".join("(" + " + ".join(f"{pf(a, x)} * {_p(x, b, 'w')}" for x in range(3)) + f") AS g{a}{b}" for a in range(3) for b in range(3))
    nxt = ", ".join(f"lead({x}) OVER w AS n{x}" for x in ["bm0", "bm1", "bm2", *[_p(i, j, "bp") for i, j in PAIRS]])
    ahead = f"SELECT *, {nxt}, {c} * lead(dt) OVER w AS cd FROM rec WINDOW w AS (PARTITION BY series ORDER BY n)"
    states = ", ".join([_p(i, j, "p") for i, j in PAIRS] + [_p(i, j, "nbp") for i, j in PAIRS])
    return f"SELECT series, n, m0, m1, m2, nbm0, nbm1, nbm2, {states}, {gain} FROM (SELECT *, {_inverse('nbp')} FROM ({ahead}) WHERE cd IS NOT NULL)"


def _step_back(t: str, back: str, covariances: bool) -> str:
    """The smoothed state s0 .. s2 (and v00 .. v22) of row t out of that of the row behind it."""
    means = [f"{t}.m{a} + " + " + ".join(f"{t}.g{a}{b} * ({back}.s{b} - {t}.nbm{b})" for b in range(3)) + f" AS s{a}" for a in range(3)]
    if covariances:
        change = lambda a, b: " + ".join(f"{t}.g{a}{x} * ({back}.{_p(x, y, 'v')} - {t}.{_p(x, y, 'nbp')}) * {t}.g{b}{y}" for x in range(3) for y in range(3))
        means += [f"{t}.{_p(a, b, 'p')} + {change(a, b)} AS v{a}{b}" for a, b in PAIRS]
    return ", ".join(means)


def _first_state(x: str, covariances: bool) -> str:
    return ", ".join([f"{x}.m{a} AS s{a}" for a in range(3)] + ([f"{x}.{_p(a, b, 'p')} AS v{a}{b}" for a, b in PAIRS] if covariances else []))


def smooth_sql(base: str, lag_us: int, c: str, covariances: bool = False) -> str:
    """CTEs on top of filter_sql: back(series, k, j, s0, s1, s2), the revised means (and covariances v00 .. v22) of released steps."""
    return f"""{base}, gains AS ({_gains(c)}),
release AS (SELECT a.series, a.n AS k, min(b.n) AS at FROM rec a JOIN rec b ON a.series = b.series AND b.us >= a.us + {lag_us} GROUP BY a.series, a.n),
back AS (SELECT r.series, r.k, r.at AS j, {_first_state('x', covariances)} FROM release r JOIN rec x ON x.series = r.series AND x.n = r.at
  UNION ALL SELECT back.series, back.k, t.n AS j, {_step_back('t', 'back', covariances)} FROM back JOIN gains t ON t.series = back.series AND t.n = back.j - 1 WHERE back.j > back.k)"""


def whole_sql(base: str, c: str) -> str:
    """CTEs on top of filter_sql, which may hold gains already: whole(series, n, s0, s1, s2, v00 .. v22), all steps smoothed back from the last."""
    gains = f", gains AS ({_gains(c)})" if "gains AS (" not in base else ""
    return f"""{base}{gains}, tips AS (SELECT series, max(n) AS n FROM rec GROUP BY series),
whole AS (SELECT x.series, x.n, {_first_state('x', True)} FROM tips JOIN rec x ON x.series = tips.series AND x.n = tips.n
  UNION ALL SELECT whole.series, t.n, {_step_back('t', 'whole', True)} FROM whole JOIN gains t ON t.series = whole.series AND t.n = whole.n - 1)"""
