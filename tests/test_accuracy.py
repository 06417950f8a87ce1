"""Stated accuracy bounds: recovered inflow at three cadences, US and SI results, covariances under extreme intervals."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest

from catchment.functions.units import SI, US
from catchment.operators.estimate import estimate, states
from catchment.plans.config import SeriesConfig

SCHEMA = "series string, us long, storage double, outflow double"
MINUTE = 60_000_000


def reservoir(seed, minutes, n=160):
    """Inflow and outflow walk, storage is their exact balance; both readings have noise: (rows, true inflow)."""
    rng = np.random.default_rng(seed)
    dt, pace = 60.0 * minutes, (minutes / 15) ** 0.5
    inflow = 30 + np.concatenate([[0], np.cumsum(rng.normal(0, pace, n - 1))])
    outflow = 10 + np.concatenate([[0], np.cumsum(rng.normal(0, pace / 4, n - 1))])
    storage = 1000 + np.concatenate([[0], np.cumsum((inflow - outflow)[:-1])]) * dt * US.flow_to_volume_per_second
    seen = np.stack([storage + rng.normal(0, 0.05, n), outflow + rng.normal(0, 0.25, n)], axis=1)
    return [(f"{minutes}", i * minutes * MINUTE, float(a), float(b)) for i, (a, b) in enumerate(seen)], inflow


def test_inflow_is_recovered_and_revision_helps(spark):
    config = SeriesConfig.diagonal(q=(1e-10, 1 / 900, 1 / 14400), r=(0.0025, 0.0625), p0=((0.1, 0, 0), (0, 25.0, 0), (0, 0, 4.0)), lag=timedelta(hours=3))
    made = {m: reservoir(100 + m, m) for m in (5, 15, 60)}
    out = estimate(spark.createDataFrame([r for rows, _ in made.values() for r in rows], SCHEMA), config).collect()
    for m, (_, truth) in made.items():
        rows = sorted((r for r in out if r.series == str(m)), key=lambda r: r.us)[10:]
        causal = np.array([r.estimated_inflow for r in rows]) - truth[10:]
        known = np.array([r.revised_inflow is not None for r in rows])
        revised = np.array([r.revised_inflow for r in rows if r.revised_inflow is not None]) - truth[10:][known]
        assert np.sqrt(np.mean(causal**2)) < 3.0
        assert np.sqrt(np.mean(revised**2)) < np.sqrt(np.mean(causal**2))


def test_units_don_t_change_the_physics(spark):
    us_config = SeriesConfig(q=((1e-4, 1e-5, 0), (1e-5, 2e-3, 1e-4), (0, 1e-4, 1e-3)), r=((0.3, 0.02), (0.02, 0.5)), p0=((4, 0.5, 0), (0.5, 90, 3), (0, 3, 40)), lag=timedelta(minutes=40), units=US)
    volume, flow = US.factors_to(SI)
    readings = [(10000.0, 25.0), (10001.0, 26.0), (10003.0, 24.0), (None, 25.0), (10006.0, None), (10008.0, 26.0), (10010.0, 25.0), (10011.0, 25.0)]
    rows = [("a", i * 15 * MINUTE, s, o) for i, (s, o) in enumerate(readings)]
    metric = [(k, u, None if s is None else s * volume, None if o is None else o * flow) for k, u, s, o in rows]
    a = {r.us: r for r in estimate(spark.createDataFrame(rows, SCHEMA), us_config, uncertainty=True).collect()}
    b = {r.us: r for r in estimate(spark.createDataFrame(metric, SCHEMA), us_config.in_units(SI), uncertainty=True).collect()}
    for u, r in a.items():
        for name in ("estimated_inflow", "revised_inflow", "estimated_inflow_standard_deviation", "revised_inflow_standard_deviation"):
            x, y = r[name], b[u][name]
            assert (x is None) == (y is None) and (x is None or y == pytest.approx(x * flow, rel=1e-7, abs=1e-9)), name


def test_covariances_stay_positive_under_extreme_intervals(spark):
    gaps = [1, 1, 1_000_000, 365 * 86_400_000_000, 1, 3_600_000_000, 30 * 86_400_000_000, 2]
    us = np.concatenate([[0], np.cumsum(gaps)]).tolist()
    rows = [("a", u, 1000.0 + i, 5.0 if i % 3 else 4.0) for i, u in enumerate(us)]
    config = SeriesConfig.diagonal(q=(1e-4, 1e-2, 1e-3), r=(0.01, 0.04), lag=timedelta(days=1))
    for r in states(spark.createDataFrame(rows, SCHEMA), config).collect():
        p = np.array([[r.p00, r.p01, r.p02], [r.p01, r.p11, r.p12], [r.p02, r.p12, r.p22]])
        assert np.linalg.eigvalsh(p)[0] >= -1e-12 * max(1, np.abs(p).max())
