"""The tuner finds what made the readings; candidates scored together equal candidates scored alone; searches and transforms against plain forms."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest

from catchment.functions.units import SI
from catchment.operators import prepare
from catchment.operators.filtering import process_covariances, transitions
from catchment.operators.scores import autocorrelation, lagged_sums, window_scores
from catchment.plans import tuning
from catchment.plans.config import ScoreSettings, SeriesConfig, Window
from catchment.plans.search import minimize

HOUR = 3_600_000_000
SCHEMA = "series string, us long, storage double, outflow double"


def made(seed, n=240, q=(0.005, 0.04, 0.02), r=(0.25, 0.16), name="s", gaps=False):
    """Readings of a state that moves with noise q, read with noise r."""
    rng = np.random.default_rng(seed)
    state, rows = np.array([10_000.0, 10.0, 3.0]), []
    step, noise = np.array([3600.0]), np.diag(q)
    f, cov = transitions(step, 1.0)[0], process_covariances(step, noise, 1.0)[0]
    for i in range(n):
        seen = [float(state[0] + rng.normal(0, r[0] ** 0.5)), float(state[2] + rng.normal(0, r[1] ** 0.5))]
        rows.append((name, i * HOUR, *[None if gaps and i > 5 and rng.random() < 0.2 else x for x in seen]))
        state = f @ state + rng.multivariate_normal(np.zeros(3), cov)
    return rows


BASE = SeriesConfig.diagonal(q=(0.002, 0.16, 0.01), r=(0.5, 0.04), p0=((1.0, 0, 0), (0, 0.25, 0), (0, 0, 0.25)), lag=timedelta(hours=1), units=SI)


def test_flow_noise_is_recovered_within_a_tenth(spark):
    windows = [Window(f"w{i}", a * HOUR, b * HOUR) for i, (a, b) in enumerate(((20, 60), (80, 120), (140, 180), (200, 230)))]
    bounds = {"q_storage": (0.1, 10.0), "q_inflow": (0.01, 10.0), "q_outflow": (0.1, 10.0), "r_storage": (0.05, 10.0), "r_outflow": (0.1, 50.0)}
    spent = []
    out = tuning.tune(spark.createDataFrame(made(1234), SCHEMA), BASE, windows, ScoreSettings(warmup=timedelta(0), least_scored=10), tuning.TuningSettings(bounds=bounds), seeds=[6.0, 12.0, 24.0], version="2", progress=lambda phase, n: spent.append((phase, n)))
    assert out["config"].q[1][1] == pytest.approx(0.04, rel=0.1) and out["config"].q[2][2] == pytest.approx(0.02, rel=0.1)
    assert out["improved"] and out["identifiability"]["standard_errors"]["q_inflow"] < 1
    searched = max(n for phase, n in spent if phase == "search") - max(n for phase, n in spent if phase == "screening")
    assert searched <= 2 * 200


def test_candidates_together_equal_each_alone(spark):
    obs = spark.createDataFrame([r for k in range(3) for r in made(k, 90, name=f"s{k}", gaps=True)], SCHEMA)
    windows = tuning.windows_frame(obs, [Window("a", 0, 30 * HOUR), Window("b", 30 * HOUR, 55 * HOUR, 2.0), Window("c", 60 * HOUR, 90 * HOUR)])
    settings = ScoreSettings(warmup=timedelta(hours=3))
    candidates = [tuning.of_config(BASE), tuning.Candidate((0.1, 0.2, 0.3, 0.4, 0.5)), tuning.Candidate((1e-6, 3.0, 1e-3, 2.0, 1.0))]
    steps = prepare.steps(obs).persist()
    alone = {(r.candidate, r.series, r.name): r for r in window_scores(tuning.candidate_scores(steps, BASE, candidates), windows, settings, ("candidate",)).collect()}
    for span in (HOUR * 10_000, HOUR * 17):
        rows, single = tuning.windowed_steps(steps, windows, settings, span)
        assert single == (span == HOUR * 10_000)
        sums = tuning.candidate_sums(rows, single, BASE, candidates)
        got = {(r.candidate, r.series, r.name): r for r in sums.collect()}
        assert set(got) == set(alone) and len(got) == 27
        for k, r in got.items():
            assert r.joint_sum / r.joint_count == pytest.approx(alone[k].joint_nlpd, abs=1e-8)
            assert (r.joint_count, r.storage_count, r.unscorable_count) == (alone[k].joint_count, alone[k].storage_count, 0)
        assert {r.objective is None for r in tuning.objective(sums, 3, windows, settings).collect()} == {False}


@pytest.mark.parametrize("seed", range(4))
def test_search_ends_at_the_least_point_of_a_bowl(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, (5, 5))
    h, low = a @ a.T + np.diag([0.01, 1, 10, 1, 0.1]), rng.uniform(-0.2, 1.2, 5)
    value = lambda points: np.array([(x - low) @ h @ (x - low) for x in points])
    x, spent = minimize(value, np.full(5, 0.5))
    assert spent <= 200
    slope = 2 * h @ (x - low)
    inside = (x > 0) & (x < 1)
    assert np.abs(slope[inside]).max(initial=0) < 0.02 and (slope[x <= 0] >= -0.02).all() and (slope[x >= 1] <= 0.02).all()


def test_search_gives_up_on_what_can_t_be_used():
    assert minimize(lambda points: np.full(len(points), np.inf), np.full(2, 0.5))[1] == 1


def test_transforms_equal_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 40)
    sums = lagged_sums(x, 25, 39).set_index("steps")
    for k in range(1, 40):
        pairs = [(x[i], x[i + k]) for i in range(25) if i + k < 40]
        want = (len(pairs), sum(a * b for a, b in pairs), sum(a * a for a, _ in pairs), sum(b * b for _, b in pairs))
        assert sums.loc[k].tolist() == pytest.approx(want, abs=1e-9)
    rows = [("even", i * HOUR, float(v)) for i, v in enumerate(rng.normal(0, 1, 500))] + [("gaps", i * HOUR, float(v)) for i, v in enumerate(rng.normal(0, 1, 200)) if i % 9] + [("flat", i * HOUR, 1.0) for i in range(9)] + [("one", 0, 1.0)]
    frame, lags = spark.createDataFrame(rows, "series string, us long, x double"), [k * HOUR for k in range(1, 60)]
    results = [{(r.series, r.lag_us): (r.autocorrelation, r.pair_count) for r in autocorrelation(frame, "x", lags, HOUR // 4, span, t).collect()} for span, t in ((HOUR * 70, True), (HOUR * 10_000, True), (HOUR * 70, False))]
    for other in results[:2]:
        assert set(other) == set(results[2])
        for k, (r, n) in results[2].items():
            assert other[k][1] == n and (other[k][0] is None) == (r is None) and (r is None or other[k][0] == pytest.approx(r, abs=1e-9))


def test_nothing_is_left_out_unsaid(spark):
    """A large table of a report is written whole, and warnings beyond those spelled out are counted."""
    from catchment.plans.job import _beside, _plain_table

    rows = spark.range(57).selectExpr("concat('s', id) AS series", "concat('text ', id) AS text")
    assert len(_plain_table(rows, "unused")) == 57
    place = _beside(spark, "report.json", "candidates")
    got = _plain_table(rows, place, most=20)
    assert got == {"rows": 57, "path": place} and spark.read.parquet(place).count() == 57
    assert _plain_table(rows.selectExpr("series", "1 AS us"), "unused") == {"rows": 57} and _plain_table(3, "unused") == 3
    listed = tuning._listed(rows, "odd warnings", most=10)
    assert len(listed) == 11 and listed[-1] == "47 more odd warnings in their table" and len(tuning._listed(rows, "odd warnings")) == 57


def test_gains_by_series_equal_the_plain_error(spark):
    rng = np.random.default_rng(2)
    gains, weights = rng.normal(0, 1, 4), np.array([1.0, 2.0, 0.5, 1.5])
    rows = [("a", f"w{i}", float(g), float(w)) for i, (g, w) in enumerate(zip(gains, weights, strict=True))] + [("b", "w0", 0.5, 2.0)]
    got = {r.series: r for r in tuning.paired_gains(spark.createDataFrame(rows, "series string, name string, gain double, weight double")).collect()}
    assert got["a"].gain == pytest.approx(weights @ gains / weights.sum()) and got["a"].error == pytest.approx(tuning.standard_error(gains, weights))
    assert (got["b"].gain, got["b"].error, got["b"].windows) == (0.5, 0.0, 1)
