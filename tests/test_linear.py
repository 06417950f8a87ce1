"""The filter for any model, its smoothers and its singular rows, against plain loops."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from catchment.operators import linear
from catchment.operators.filtering import WaterBalance, process_bases, process_covariances
from catchment.plans.config import SeriesConfig

HOUR = 3_600_000_000


def plain_filter(y, f, q, h, r, mean, cov):
    """[(m, P, m before, P before)] of one series; f[k] and q[k] lead to row k."""
    out, m, p = [], np.array(mean, float), np.array(cov, float)
    for k in range(len(y)):
        if k:
            m, p = f[k] @ m, f[k] @ p @ f[k].T + q[k]
        bm, bp = m, p
        see = np.isfinite(y[k])
        if see.any():
            hk = h[k][see]
            s = hk @ p @ hk.T + r[k][np.ix_(see, see)]
            g = p @ hk.T @ np.linalg.pinv(s)
            m = m + g @ (y[k][see] - hk @ m)
            rest = np.eye(len(m)) - g @ hk
            p = rest @ p @ rest.T + g @ r[k][np.ix_(see, see)] @ g.T
        out.append((m, p, bm, bp))
    return out


def plain_back(steps, f, first, last):
    """Smoothed (m, P) of row `first`, back from row `last`."""
    m, p = steps[last][0], steps[last][1]
    for k in range(last - 1, first - 1, -1):
        g = steps[k][1] @ f[k + 1].T @ np.linalg.pinv(steps[k + 1][3])
        m, p = steps[k][0] + g @ (m - steps[k + 1][2]), steps[k][1] + g @ (p - steps[k + 1][3]) @ g.T
    return m, p


def random_series(rng, n, k, m):
    f = np.eye(k) + rng.normal(0, 0.1, (n, k, k))
    a, b = rng.normal(0, 1, (n, k, k)), rng.normal(0, 1, (n, m, m))
    q, r = a @ np.swapaxes(a, 1, 2) * 0.3, b @ np.swapaxes(b, 1, 2) + np.eye(m) * 0.1
    h, y = rng.normal(0, 1, (n, m, k)), rng.normal(0, 2, (n, m))
    y[rng.random((n, m)) < 0.25] = np.nan
    us = np.cumsum(rng.integers(1, 20, n)) * HOUR
    return us, y, f, q, h, r


def test_four_states_and_two_readings_equal_loops(spark):
    rng = np.random.default_rng(2)
    k, m, mean, cov = 4, 2, [1.0, 0, -1, 2], np.diag([4.0, 1, 2, 3]).tolist()
    rows, made = [], {}
    for name, n in (("a", 70), ("b", 1), ("c", 33)):
        us, y, f, q, h, r = made[name] = random_series(rng, n, k, m)
        rows += [(name, int(us[i]), *[None if np.isnan(v) else float(v) for v in y[i]], *[x[i].ravel().tolist() for x in (f, q, h, r)]) for i in range(n)]
    obs = spark.createDataFrame(rows, "series string, us long, y0 double, y1 double, f array<double>, q array<double>, h array<double>, r array<double>")
    model = linear.Given(("y0", "y1"), "f", "q", "h", "r", mean, cov)
    assert isinstance(model, linear.Model) and isinstance(WaterBalance(SeriesConfig()), linear.Model)
    steps = linear.model_steps(obs, model)
    assert linear.matrix_faults(steps, model).count() == 0
    lag = 30 * HOUR
    for span in (40 * HOUR, 10_000 * HOUR):
        states = linear.filtered(steps, model, span=span).persist()
        back = {(r.series, r.us): r for r in linear.smoothed_back(states, model, span).collect()}
        fixed = {(r.series, r.us): r for r in linear.smoothed_by_lag(states, model, lag, span).collect()}
        got = {(r.series, r.us): r for r in states.collect()}
        assert len(got) == len(rows)
        for name, (us, y, f, q, h, r) in made.items():
            want = plain_filter(y, f, q, h, r, mean, cov)
            for i in range(len(us)):
                own = got[name, us[i]]
                assert np.allclose([own[f"m{j}"] for j in range(k)], want[i][0], atol=1e-7)
                assert np.allclose(own["p13"], want[i][1][1, 3], atol=1e-7)
                ms, ps = plain_back(want, f, i, len(us) - 1)
                assert np.allclose([back[name, us[i]][f"sm{j}"] for j in range(k)], ms, atol=1e-6) and np.allclose(back[name, us[i]].sp02, ps[0, 2], atol=1e-6)
                later = np.flatnonzero(us >= us[i] + lag)
                row = fixed[name, us[i]]
                assert row.released == bool(len(later))
                if len(later):
                    ms, ps = plain_back(want, f, i, later[0])
                    assert row.release_us == us[later[0]]
                    assert np.allclose([row[f"sm{j}"] for j in range(k)], ms, atol=1e-6) and np.allclose(row.sp22, ps[2, 2], atol=1e-6)


def test_scalar_golden_values(spark):
    # A walk of noise 1 read with noise 1, from a state of mean 0 and variance 4.
    model = linear.Given(("y",), [[1.0]], [[1.0]], [[1.0]], [[1.0]], [0.0], [[4.0]])
    obs = spark.createDataFrame([("a", 0, 2.0), ("a", HOUR, 2.5)], "series string, us long, y double")
    rows = linear.filtered(linear.model_steps(obs, model), model).orderBy("us").collect()
    assert rows[0].m0 == pytest.approx(1.6) and rows[0].p00 == pytest.approx(0.8) and rows[1].m0 == pytest.approx(2.17857143)
    first = linear.first_step([0.0], [[4.0]], [2.0], [[1.0]], [[1.0]])
    second = linear.single_step(first.mean, first.cov, [[1.0]], [[1.0]], [2.5], [[1.0]], [[1.0]])
    assert first.mean[0] == pytest.approx(1.6) and second.mean[0] == pytest.approx(rows[1].m0) and second.log_density == pytest.approx(rows[1].log_density)
    blank = linear.single_step(first.mean, first.cov, [[1.0]], [[1.0]], [np.nan], [[1.0]], [[1.0]])
    assert blank.mean[0] == first.mean[0] and blank.cov[0, 0] == pytest.approx(1.8) and not blank.complete and blank.log_density == 0


@pytest.mark.parametrize("change", [{"mean": [np.inf]}, {"cov": [[-1.0]]}, {"y": [np.inf]}, {"y": []}, {"h": [[1.0, 2.0]]}, {"r": [[-1.0]]}])
def test_first_step_refuses(change):
    good = {"mean": [0.0], "cov": [[4.0]], "y": [2.0], "h": [[1.0]], "r": [[1.0]]}
    with pytest.raises(ValueError):
        linear.first_step(**(good | change))


@pytest.mark.parametrize("change", [{"f": [[1.0, 0.0]]}, {"q": [[-1.0]]}, {"h": [[np.nan]]}, {"mean": []}, {"cov": [[np.nan]]}, {"reads": ()}])
def test_given_refuses(change):
    good = {"reads": ("y",), "f": [[1.0]], "q": [[1.0]], "h": [[1.0]], "r": [[1.0]], "mean": [0.0], "cov": [[4.0]]}
    with pytest.raises(ValueError):
        linear.Given(**(good | change))


def test_infinite_reading_is_an_error(spark):
    model = linear.Given(("y",), [[1.0]], [[1.0]], [[1.0]], [[1.0]], [0.0], [[4.0]])
    obs = spark.createDataFrame([("a", 0, float("inf")), ("a", 1, float("nan"))], "series string, us long, y double")
    with pytest.raises(Exception, match="y is infinite in series a"):
        linear.model_steps(obs, model).collect()
    assert [tuple(r) for r in linear.infinite_readings(obs, ("y",)).collect()] == [("a", 0, "y")]


def test_a_singular_row_leaves_its_neighbours_alone():
    rng = np.random.default_rng(4)
    n = 50
    m, p = rng.normal(0, 1, (n, 2)), np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    p[7] = [[1e12, 1e3], [1e3, 1e-9]]
    h, r = np.broadcast_to([[1.0, 0.0], [0.0, 1.0]], (n, 2, 2)).copy(), np.broadcast_to(np.eye(2) * 1e-10, (n, 2, 2)).copy()
    y = rng.normal(0, 1, (n, 2))
    alone = linear.update(m, p, y, h, r)
    p[20], r[20] = 0, 0
    both = linear.update(m, p, y, h, r)
    for a, b in zip(alone, both, strict=True):
        assert np.array_equal(np.delete(a, 20, 0), np.delete(b, 20, 0))
    assert np.array_equal(both[0][20], m[20])


def test_density_is_raised_by_the_rows_own_scale():
    s = np.array([np.eye(2), [[4.0, 4.0], [4.0, 4.0]], np.zeros((2, 2)), [[1e12, 1e12], [1e12, 1e12]]])
    v = np.array([[1.0, 2.0], [1.0, 1.0], [0.0, 0.0], [1e6, 1e6]])
    got = linear.log_density(v, s, np.array([2, 2, 2, 2]))
    assert got[0] == pytest.approx(-0.5 * (2 * np.log(2 * np.pi) + 5)) and np.isfinite(got[[1, 3]]).all() and np.isnan(got[2])
    # The same row in other units differs by the units only.
    assert got[3] + 2 * np.log(5e5) == pytest.approx(got[1] + np.log(1), rel=0.05)
    assert linear.log_density(v[:1], s[:1], np.array([0]))[0] == 0


def test_noise_is_the_sum_of_its_bases():
    dt, q = np.array([0.5, 3600.0]), np.array([[1.0, 0.2, 0.1], [0.2, 2.0, 0.3], [0.1, 0.3, 3.0]])
    assert np.allclose(np.einsum("b,nbij->nij", q.ravel(), process_bases(dt, 0.7)), process_covariances(dt, q, 0.7))


def test_ten_times_the_lag_costs_little_more(spark):
    n = 3000
    obs = spark.createDataFrame(pd.DataFrame({"series": np.repeat([f"s{i}" for i in range(8)], n), "us": np.tile(np.arange(n) * 600_000_000, 8), "y": np.random.default_rng(0).normal(0, 1, 8 * n)}), "series string, us long, y double")
    model = linear.Given(("y",), [[1.0, 1.0], [0.0, 1.0]], [[0.1, 0.0], [0.0, 0.01]], [[1.0, 0.0]], [[1.0]], [0.0, 0.0], [[4.0, 0.0], [0.0, 1.0]])
    states = linear.filtered(linear.model_steps(obs, model), model).persist()
    states.count()

    def seconds(hours):
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            linear.smoothed_by_lag(states, model, hours * HOUR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        return min(runs)

    short = seconds(6)
    assert seconds(60) < 1.5 * short


def test_a_stream_takes_no_matrices_from_columns(spark):
    from catchment.streaming.inflow import stream_states

    model = linear.Given(("y",), "f", [[1.0]], [[1.0]], [[1.0]], [0.0], [[4.0]])
    with pytest.raises(ValueError, match="f"):
        stream_states(None, model, 1, 0, "mark")
