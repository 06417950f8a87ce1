from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest
from reference_filter import back, kept, revise, run

from catchment.functions.units import SI
from catchment.operators.estimate import estimate, states, with_intervals
from catchment.operators.filtering import smoothed
from catchment.operators.prepare import active_counts, order_faults, release_times, split_windows, starts, steps
from catchment.plans.config import SeriesConfig

SCHEMA = "series string, us long, storage double, outflow double"
HOUR = 3_600_000_000


def make(seed, n=60, series=4):
    rng = np.random.default_rng(seed)
    out = {}
    for s in range(series):
        us = np.cumsum(rng.integers(1, 7200 * 10**6, size=n if s else 3)).tolist()
        storage = (100 + np.cumsum(rng.normal(size=len(us)))).tolist()
        outflow = (5 + rng.normal(size=len(us))).tolist()
        for i in range(len(us)):
            if i > 2 and rng.random() < 0.2:
                storage[i] = np.nan
            if i > 2 and rng.random() < 0.2:
                outflow[i] = np.nan
        if s == 1:
            storage[0], storage[2] = np.nan, np.nan
        out[f"s{s}"] = list(zip(us, storage, outflow, strict=True))
    out["short"] = [(5, 1.0, 1.0), (6, np.nan, 2.0)]
    out["none"] = [(5, np.nan, 1.0)]
    return out


def frame(spark, data):
    clean = lambda x: None if np.isnan(x) else x
    return spark.createDataFrame([(s, u, clean(a), clean(b)) for s, rows in data.items() for u, a, b in rows], SCHEMA).repartition(3)


CONFIGS = [
    SeriesConfig.diagonal(lag=timedelta(hours=5), units=SI),
    SeriesConfig(q=((0.3, 0.05, 0), (0.05, 0.2, 0.01), (0, 0.01, 0.1)), r=((0.4, 0.1), (0.1, 0.3)), p0=((5, 1, 0), (1, 4, 0.5), (0, 0.5, 3)), lag=timedelta(minutes=90)),
]


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("span", [HOUR, 12 * HOUR, 10**15])
def test_filter_and_revision_match_one_series_at_a_time(spark, config, span):
    data = make(3)
    got = {(r.series, r.us): r for r in estimate(frame(spark, data), config, uncertainty=True, span=span).collect()}
    assert len(got) == sum(map(len, data.values()))
    for s, rows in data.items():
        done = run(rows, config)
        revised = revise(rows, done, config.lag_us)
        at = {i: (m, p) for i, m, p, *_ in done}
        for i, (us, a, b) in enumerate(rows):
            r = got[s, us]
            if i not in at:
                assert r.estimated_inflow is None and r.revised_inflow is None and r.estimated_inflow_flag is None
                continue
            m, p = at[i]
            assert r.estimated_inflow == pytest.approx(m[1], rel=1e-8, abs=1e-8)
            assert r.estimated_inflow_standard_deviation == pytest.approx(p[1, 1] ** 0.5, rel=1e-8, abs=1e-8)
            assert r.estimated_inflow_flag == ("NORMAL" if np.isfinite(a) and np.isfinite(b) else "PREDICTED")
            assert (r.revised_inflow is None) == (i not in revised)
            if i in revised:
                assert r.revised_inflow == pytest.approx(revised[i][0][1], rel=1e-7, abs=1e-7)
                assert r.revised_inflow_standard_deviation == pytest.approx(revised[i][1][1, 1] ** 0.5, rel=1e-7, abs=1e-7)
                assert r.revised_inflow_smoothing_flag == "SMOOTHED" and r.revised_inflow_flag == r.estimated_inflow_flag


def test_whole_record_and_provisional_smoothing(spark):
    data, config = {"s1": make(5)["s1"]}, CONFIGS[0]
    rows = data["s1"]
    done = run(rows, config)
    whole = {r.us: r for r in smoothed(states(frame(spark, data), config), config, whole=True).collect()}
    part = {r.us: r for r in smoothed(states(frame(spark, data), config), config, provisional=True).collect()}
    released = revise(rows, done, config.lag_us)
    for k, (i, *_) in enumerate(done):
        m, p = back(done, k, len(done) - 1)
        assert whole[rows[i][0]].sm1 == pytest.approx(m[1], abs=1e-7) and whole[rows[i][0]].sp11 == pytest.approx(p[1, 1], abs=1e-7)
        want = released[i][0] if i in released else m
        assert part[rows[i][0]].sm1 == pytest.approx(want[1], abs=1e-7) and part[rows[i][0]].released == (i in released)


@pytest.mark.parametrize("span", [3 * HOUR, 10**15])
def test_whole_smoothing_in_spans(spark, span):
    config, data = CONFIGS[1], {"s1": make(5)["s1"], "s2": make(6)["s2"]}
    whole = {(r.series, r.us): r for r in smoothed(states(frame(spark, data), config), config, whole=True, span=span).collect()}
    for s, rows in data.items():
        plain_steps = run(rows, config)
        for k, (i, *_) in enumerate(plain_steps):
            m, p = back(plain_steps, k, len(plain_steps) - 1)
            r = whole[s, rows[i][0]]
            assert r.sm1 == pytest.approx(m[1], abs=1e-6) and r.sp11 == pytest.approx(p[1, 1], abs=1e-6)


def test_repeated_and_missing_times_are_an_error(spark):
    config = SeriesConfig.diagonal(lag=timedelta(hours=3))
    rows = [("a", i * HOUR, 10.0 + i, 1.0) for i in range(5)]
    for bad in (("a", 2 * HOUR, 5.0, 1.0), ("a", None, 5.0, 1.0)):
        with pytest.raises(ValueError, match="repeated|missing"):
            estimate(spark.createDataFrame([*rows, bad], "series string, us long, storage double, outflow double"), config)


def test_intervals(spark):
    result = with_intervals(estimate(frame(spark, make(1)), CONFIGS[0], uncertainty=True), 0.9)
    for r in result.filter("estimated_inflow IS NOT NULL").collect():
        assert r.estimated_inflow_upper - r.estimated_inflow == pytest.approx(1.6448536269514722 * r.estimated_inflow_standard_deviation)
    with pytest.raises(ValueError):
        with_intervals(result, 1.0)


def test_first_storage_needs_outflow(spark):
    obs = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="outflow"):
        steps(obs).collect()
    assert steps(obs, strict=False).count() == 0


def test_window_overflow(spark):
    obs = spark.createDataFrame([("a", i * HOUR, 100.0 + i, 4.0) for i in range(6)], SCHEMA)
    small = SeriesConfig.diagonal(lag=timedelta(hours=4), max_window=3)
    with pytest.raises(OverflowError, match="max_window"):
        estimate(obs, small).collect()
    assert estimate(obs, SeriesConfig.diagonal(lag=timedelta(hours=3), max_window=3)).count() == 6


@pytest.mark.parametrize("span", [3, 10, 1000])
def test_release_times_and_counts(spark, span):
    rng = np.random.default_rng(8)
    rows = [(s, int(u)) for s in "abc" for u in sorted(set(rng.integers(0, 200, size=40).tolist()))]
    df = spark.createDataFrame(rows, "series string, us long")
    for lag in (1, 7, 30):
        got = {(r.series, r.us): r.release_us for r in release_times(df, lag, span).collect()}
        counts = {(r.series, r.us): r.active for r in active_counts(df, lag, span).collect()}
        for s, u in rows:
            own = [v for t, v in rows if t == s]
            assert got[s, u] == min((v for v in own if v >= u + lag), default=None)
            assert counts[s, u] == sum(u - lag < v <= u for v in own)


def test_starts_and_faults(spark):
    data = make(2)
    got = {r.series: r for r in starts(frame(spark, data)).collect()}
    for s, rows in data.items():
        k = kept(rows)
        if k:
            assert (got[s].first_us, got[s].second_us) == (rows[k[0]][0], rows[k[1]][0])
    assert got["short"].second_us is None and "none" not in got
    bad = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 1, 2.0, 1.0), ("a", None, 1.0, 1.0)], SCHEMA)
    assert sorted(r.fault for r in order_faults(bad).collect()) == ["missing", "repeated"]


@pytest.mark.parametrize(("n", "k"), [(20, 6), (7, 3), (2, 5)])
def test_split_windows(spark, n, k):
    df = spark.createDataFrame([("a", i * 10) for i in range(n)], "series string, us long")
    got = split_windows(df, k).orderBy("start_us").collect()
    parts = [p for p in np.array_split(np.arange(n) * 10, k) if len(p)]
    assert [(r.start_us, r.n) for r in got] == [(p[0], len(p)) for p in parts]
    assert [r.end_us for r in got] == [*[p[0] for p in parts[1:]], (n - 1) * 10 + 1]


def test_nothing(spark):
    assert estimate(spark.createDataFrame([], SCHEMA), CONFIGS[0], uncertainty=True).count() == 0


def test_units():
    us = CONFIGS[1]
    back_again = us.in_units(SI).in_units(us.units)
    assert np.allclose(back_again.q, us.q) and np.allclose(back_again.r, us.r) and us.in_units(SI).q[0][0] == pytest.approx(us.q[0][0] * (43560 * 0.3048**3) ** 2)
    assert us.fingerprint() != us.in_units(SI).fingerprint()
