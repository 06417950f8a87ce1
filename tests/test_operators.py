from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from reference_filter import run

from catchment.functions import units
from catchment.functions.units import SI
from catchment.operators import align, prepare, reading_noise, scores, validation
from catchment.operators.estimate import states
from catchment.plans import tuning
from catchment.plans.config import ScoreSettings, SeriesConfig, Window, checked_windows, plain
from catchment.sources import gauges
from catchment.sources.shared import new_dir

HOUR = 3_600_000_000
OBS = "series string, us long, storage double, outflow double"


def simulate(seed, n=240, q=(0.005, 0.04, 0.02), r=(0.25, 0.16)):
    rng = np.random.default_rng(seed)
    x = np.array([1000.0, 5.0, 5.0])
    rows = []
    for i in range(n):
        if i:
            x = x + np.array([3600 * (x[1] - x[2]), 0, 0]) + np.array([rng.normal(0, np.sqrt(q[0] * 3600)), rng.normal(0, np.sqrt(q[1] * 3600) / 60), rng.normal(0, np.sqrt(q[2] * 3600) / 60)])
        rows.append(("a", i * HOUR, float(x[0] + rng.normal(0, r[0] ** 0.5)), float(x[2] + rng.normal(0, r[1] ** 0.5))))
    return rows


def test_scores_match_densities(spark):
    rng = np.random.default_rng(2)
    rows = [(s, u, None if i > 3 and rng.random() < 0.3 else a, None if i > 3 and rng.random() < 0.3 else b) for i, (s, u, a, b) in enumerate(simulate(1, 60))]
    config = SeriesConfig.diagonal(q=(0.01, 0.04, 0.02), r=(0.25, 0.16), units=SI)
    got = {r.us: r for r in scores.row_scores(states(spark.createDataFrame(rows, OBS), config)).collect()}
    nan = lambda x: np.nan if x is None else x
    plain_rows = [(u, nan(a), nan(b)) for _, u, a, b in rows]
    for i, _, _, bm, bp, _ in run(plain_rows, config):
        us, a, b = plain_rows[i]
        seen = np.isfinite([a, b])
        h = np.array([[1.0, 0, 0], [0, 0, 1.0]])[seen]
        if not seen.any():
            assert got[us].joint_nlpd is None and got[us].joint_components == 0
            continue
        v = np.array([a, b])[seen] - h @ bm
        s = h @ bp @ h.T + np.array(config.r)[np.ix_(seen, seen)]
        nis = v @ np.linalg.solve(s, v)
        assert got[us].joint_nis == pytest.approx(nis, rel=1e-7, abs=1e-9)
        assert got[us].joint_nlpd == pytest.approx(0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + nis), rel=1e-7)
        if seen.all():
            var, e = s[0, 0] - s[0, 1] ** 2 / s[1, 1], v[0] - s[0, 1] * v[1] / s[1, 1]
            assert got[us].storage_nlpd == pytest.approx(0.5 * (np.log(2 * np.pi) + np.log(var) + e * e / var), rel=1e-7)


def test_autocorrelation_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    us = np.cumsum(rng.integers(1, 40, size=80)).tolist()
    x = [None if rng.random() < 0.1 else float(rng.normal()) for _ in us]
    df = spark.createDataFrame([("a", int(u), v) for u, v in zip(us, x, strict=True)], "series string, us long, x double")
    lags, tol = [20, 40, 60], 7
    got = {r.lag_us: r for r in scores.autocorrelation(df, "x", lags, tol).collect()}
    known = [(u, v) for u, v in zip(us, x, strict=True) if v is not None]
    mean = np.mean([v for _, v in known])
    for lag in lags:
        pairs = [(a - mean, b - mean) for i, (u, a) in enumerate(known) for w, b in known[i + 1 :] if abs(w - u - lag) <= tol]
        a, b = np.array(pairs).T
        assert got[lag].pair_count == len(pairs)
        assert got[lag].autocorrelation == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_cadence_lags_are_each_series_own(spark):
    rows = [("a", t * 1_000_000_000) for t in range(5)] + [("b", t * 1_000) for t in range(5)] + [("c", 7)]
    df = spark.createDataFrame([(s, u, float(u % 7)) for s, u in rows], "series string, us long, x double")
    got = scores.cadence_lags(df.filter("series <> 'b'"), 3_600_000_000)
    assert [tuple(r) for r in got.orderBy("lag_us").collect()] == [("a", k * 1_000_000_000, 250_000_000) for k in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="lags in series b"):
        scores.cadence_lags(df, 3_600_000_000).collect()
    found = {(r.series, r.lag_us): r.pair_count for r in scores.autocorrelation(df, "x", scores.cadence_lags(df, 5_000)).collect()}
    # A tolerance of a second takes in all pairs of the fast series.
    assert found == {("b", k * 1_000): 10 for k in range(1, 6)}


def test_positional_lags(spark):
    x = [1.0, 2.0, None, 5.0, 4.0, 7.0]
    y = [3.0, None, 1.0, 2.0, 8.0, 1.0]
    df = spark.createDataFrame([("a", 10 * i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "series string, us long, x double, y double")
    got = {r.lag: r for r in scores.positional_lags(df, "x", "y", [-2, 0, 1, 5]).collect()}
    for k, r in got.items():
        pairs = [(x[i], y[i - k]) for i in range(6) if 0 <= i - k < 6 and x[i] is not None and y[i - k] is not None]
        assert r.pair_count == len(pairs)
        assert (r.correlation is None) if len(pairs) < 2 else r.correlation == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])


def test_autocorrelation_metrics_and_their_warning(spark):
    obs = spark.createDataFrame(simulate(4, 120), OBS)
    config = SeriesConfig.diagonal(q=(0.005, 0.04, 0.02), r=(0.25, 0.16), units=SI)
    out = tuning.evaluate(obs, config, settings=ScoreSettings(warmup=timedelta(hours=2), autocorrelation_limit=1e-6))
    row = out["pooled"].first()
    three = [row[f"max_{c}_elapsed_lag_autocorrelation"] for c in scores.CHANNELS]
    assert all(0 <= v <= 1 for v in three) and row[scores.MATERIAL] == max(three)
    assert scores.MATERIAL in {r.metric for r in out["warnings"].collect()}


@pytest.mark.parametrize("span", [7, 50, 10**6])
def test_asof_against_pandas(spark, span):
    rng = np.random.default_rng(span)
    clock = pd.DataFrame({"us": np.unique(rng.integers(0, 300, 60))})
    right = pd.DataFrame({"us": np.unique(rng.integers(0, 300, 40))})
    right["value"] = np.where(rng.random(len(right)) < 0.3, np.nan, rng.normal(size=len(right)))
    want = pd.merge_asof(clock, right, on="us", tolerance=7)
    left = spark.createDataFrame([("s", int(u)) for u in clock.us], "series string, us long")
    readings = spark.createDataFrame([("s", int(u), "x", None if np.isnan(v) else float(v)) for u, v in right.itertuples(index=False)], "series string, us long, source string, value double")
    got = align._asof(left, readings, ["x"], 7, span).orderBy("us").collect()
    assert [r.x for r in got] == [None if np.isnan(v) else v for v in want.value]


def test_outflow_rule_and_trim(spark):
    rows = [("a", i, 1.0, 10.0, s, None) for i, s in enumerate([None, 5.0, -1.0, 2.0])] + [("b", i, 1.0, 10.0 + i, None, 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "series string, us long, storage double, outlet double, spillway double, upstream double")
    out = align.from_first_joint(align.combined_outflow(df, 0, 3))
    assert [r.outflow for r in out.filter("series = 'a'").orderBy("us").collect()] == [15.0, None, 12.0]
    assert [r.outflow for r in out.filter("series = 'b'").orderBy("us").collect()] == [10.0, 11.0, 12.0]
    audit = {r.series: r for r in align.window_audit(out).collect()}
    assert (audit["a"].spillway_unknown, audit["a"].spillway_invalid, audit["a"].spillway_used) == (1, 1, 2)


def test_export_is_read_cleaned_and_audited(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("# Time-series identifier: ID.1\n# Value units: cfs\nISO 8601 UTC,Value\n2024-01-01T01:00:00Z,2\n2024-01-01T00:00:00Z,1\nbad,9\n2024-01-01T01:00:00Z,3\n2024-01-01T02:00:00Z,oops\n")
    raw = gauges.parsed(gauges.read_export(spark, str(path), "storage"))
    got = gauges.clean(raw).orderBy("us").collect()
    assert [r.value for r in got] == [1.0, 3.0, None] and got[1].us - got[0].us == HOUR
    audit = gauges.source_audit(raw).first()
    assert (audit.source_rows, audit.clean_rows, audit.timestamp_parse_failures, audit.duplicates_removed, audit.median_interval_min, audit.gaps_over_20min) == (5, 3, 1, 1, 60.0, 2)
    assert {(r.key, r.value) for r in gauges.read_header(spark, str(path)).collect()} == {("Time-series identifier", "ID.1"), ("Value units", "cfs")}
    catalog = {"Lake": {"storage": str(path), "outlet": str(path), "upstream": str(path), "spillway": str(tmp_path / "none.csv")}}
    found = gauges.find_sources(spark, catalog, "LAKE")
    assert found.spillway is None and not found.combine_spillway
    with pytest.raises(FileNotFoundError):
        gauges.find_sources(spark, {"Lake": catalog["Lake"] | {"outlet": str(tmp_path / "no.csv")}}, "lake")
    with pytest.raises(ValueError):
        gauges.write_report(str(path), {}, str(path))
    gauges.write_report(str(tmp_path / "r.json"), {"b": float("nan"), "a": timedelta(hours=1), "c": np.arange(2)})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": 3600.0,\n  "b": null,\n  "c": [\n    0,\n    1\n  ]\n}\n'


def test_regular_clock_and_rolling_mean(spark):
    rng = np.random.default_rng(1)
    us = np.unique(rng.integers(0, 40 * HOUR, 50)) + 5 * HOUR
    x = rng.normal(size=len(us))
    df = spark.createDataFrame([("a", int(u), float(v)) for u, v in zip(us, x, strict=True)], "series string, us long, x double")
    s = pd.Series(x, index=pd.to_datetime(us, unit="us"))
    for hours in (1, 7):
        want = s.resample(f"{hours}h").mean()
        got = validation.regular(df, ["x"], hours * HOUR).orderBy("us").collect()
        assert [r.us for r in got] == (want.index.astype("datetime64[us]").astype("int64")).tolist()
        assert np.allclose([np.nan if r.x is None else r.x for r in got], want.to_numpy(), equal_nan=True)
    want = s.rolling("6h", center=True, min_periods=1).mean()
    for span in (4 * HOUR, 10**12):
        got = validation.rolling_mean(df, "x", 6 * HOUR, "m", span).orderBy("us").collect()
        assert np.allclose([r.m for r in got], want.to_numpy())


def test_agreement_by_hand(spark):
    rows = [("a", i * HOUR, "e", float(v), float(u)) for i, (v, u) in enumerate(zip([2, 4, 8, 6, 10], [1, 2, 3, 4, 5], strict=True))]
    df = spark.createDataFrame(rows, "series string, us long, estimate string, value double, upstream_flow double")
    r = validation.agreement(df).first()
    assert r.pearson_correlation == pytest.approx(0.9) and r.spearman_correlation == pytest.approx(0.9)
    assert r.kge == pytest.approx(1 - np.sqrt(2.01)) and r.percent_bias == pytest.approx(100) and r.nse == pytest.approx(-4.9) and r.normalized_rmse == pytest.approx(np.sqrt(59 / 45))
    few = validation.agreement(df.limit(1)).first()
    assert few.pearson_correlation is None and few.paired_observations == 1


def test_lag_closure_and_behavior_by_hand(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=9).tolist()
    rows = [("a", i * HOUR, "e", None if i == 0 else u[i - 1], u[i], None, None) for i in range(9)]
    schema = "series string, us long, estimate string, value double, upstream_flow double, storage double, outflow double"
    best = validation.best_lags(validation.lagged_correlations(spark.createDataFrame(rows, schema), 3)).first()
    assert best.best_lag_hours == 1 and best.max_correlation == pytest.approx(1) and best.paired_observations_at_best_lag == 8
    rows = [("a", t * 1_000_000, "e", v, None, s, o) for t, v, s, o in ((0, 2.0, 0.0, 1.0), (3600, 10.0, 3600.0, 3.0), (7200, 999.0, 28800.0, 999.0))]
    c = validation.closure(spark.createDataFrame(rows, schema), 1.0).first()
    assert (c.paired_observations, c.coverage, c.rmse) == (2, 1.0, 0.0)
    rows = [("a", i * HOUR, "e", v, None, None, None) for i, v in enumerate([-1.0, None, 2.0, -3.0])]
    b = validation.behavior(spark.createDataFrame(rows, schema)).first()
    assert (b.finite_observations, b.mean_negative_inflow_cfs, b.mean_absolute_hourly_change_cfs) == (3, 2.0, 5.0) and b.negative_hour_frequency_percent == pytest.approx(200 / 3)


def test_validation_tables_freeze_the_training_lag(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=49)
    rows = [("a", i * HOUR, 1000.0 + i, 4.0, float(u[i - 1] if i else 0), float(u[i - 1] if i else 0), float(u[i])) for i in range(48)]
    df = spark.createDataFrame(rows, "series string, us long, storage double, outflow double, estimated_inflow double, revised_inflow double, upstream_flow double")
    s = validation.ValidationSettings(training=(None, 23 * HOUR), lag_range=4, factor=1.0)
    assert s.evaluated == (24 * HOUR, None)
    tables = validation.validation_tables(df, s)
    lag = {r.estimate: r for r in tables["lags"].collect()}
    assert lag["estimated_inflow"].best_lag_hours == 1 and lag["estimated_inflow"].lag_selection.startswith("training")
    assert tables["agreement"].count() == 4 and tables["closure"].count() == 4 and tables["behavior"].count() == 4


def test_reading_noise_finds_the_variance(spark):
    rng = np.random.default_rng(3)
    n = 1200
    storage = 1000 + 20 * np.sin(np.arange(n) / 60) + rng.normal(0, 2, n)
    df = spark.createDataFrame([("a", i * HOUR // 4, float(v)) for i, v in enumerate(storage)], "series string, us long, storage double")
    r = reading_noise.reading_noise(df).first()
    assert r.pairs == n - 2 and r.blocks == 2 and r.r_storage == pytest.approx(4, rel=0.15)
    few = reading_noise.reading_noise(df.filter(f"us < {50 * HOUR // 4}"))
    assert few.first().r_storage is None and few.first().pairs == 48
    assert [w.warning for w in reading_noise.reading_noise_warnings(few).collect()] == ["no estimate: too few evenly spaced pairs"]


@pytest.mark.parametrize("delay", [-2, 0, 2])
def test_proxy_lag(spark, delay):
    x = np.random.default_rng(7).normal(size=104)
    rows = [("a", i * HOUR, float(x[i + 2 - delay]), float(x[i + 2])) for i in range(100)]
    r = reading_noise.proxy_check(spark.createDataFrame(rows, "series string, us long, estimate double, proxy double")).first()
    assert r.proxy_best_lag_seconds == delay * 3600 and r.proxy_check_passed and r.proxy_shape_correlation == pytest.approx(1)


def test_window_checks():
    assert [w.weight for w in checked_windows([Window("a", 0, 5), Window("b", 5, 9, 3.0)])] == [0.25, 0.75]
    for bad in ([], [Window("a", 0, 5), Window("a", 5, 6)], [Window("a", 0, 5), Window("b", 4, 6)]):
        with pytest.raises(ValueError):
            checked_windows(bad)
    with pytest.raises(ValueError):
        Window("a", 5, 5)
    with pytest.raises(ValueError):
        SeriesConfig(q=((1, 2, 0), (2, 1, 0), (0, 0, 1)))
    with pytest.raises(ValueError):
        SeriesConfig(r=((0, 0), (0, 1)))
    assert plain({"a": float("inf")}) == {"a": None}


def test_errors_of_means():
    d, w = np.array([1.0, 2.0, 4.0, 3.0, 5.0]), np.full(5, 0.2)
    assert tuning.standard_error(d, w) == pytest.approx(d.std(ddof=1) / 5**0.5)
    assert tuning.standard_error(d[:1], w[:1]) == 0
    assert tuning.paired_error(d, w, ScoreSettings()) == pytest.approx(d.std(ddof=0) / 5**0.5, rel=0.15)


def test_tuning_improves_on_a_poor_base(spark):
    obs = spark.createDataFrame(simulate(11, 160), OBS)
    base = SeriesConfig.diagonal(q=(0.005, 0.4, 0.02), r=(0.25, 0.16), units=SI)
    windows = [Window(f"w{i}", a * HOUR, b * HOUR) for i, (a, b) in enumerate(((10, 50), (60, 100), (110, 150)))]
    seen = []
    out = tuning.tune(obs, base, windows, ScoreSettings(warmup=timedelta(hours=2)), tuning.TuningSettings(evaluations=15, local_searches=1, estimate_r_storage=False, check_identifiability=False), progress=lambda phase, n: seen.append((phase, n)))
    assert out["improved"] and out["objective"] < out["base_objective"] and out["config"].version == "1-tuned"
    assert seen and out["candidates"].count() == out["passes"]
    assert out["improvement"] == pytest.approx(out["base_objective"] - out["objective"], abs=1e-9) and out["improvement_error"] >= 0
    assert out["proxies"] is None and out["compared_windows"].count() == 6
    assert "with fewer than five windows, errors are weak" in out["selection_warnings"]
    with pytest.raises(tuning.TuningError):
        tuning.tune(obs, base, [Window(f"v{i}", (1000 + i) * HOUR, (1001 + i) * HOUR) for i in range(3)], tuning=tuning.TuningSettings(evaluations=15, estimate_r_storage=False, check_identifiability=False))


def test_identifiability_ignores_window_weights(spark):
    obs = spark.createDataFrame(simulate(7, 90), OBS)
    base = SeriesConfig.diagonal(q=(0.005, 0.04, 0.02), r=(0.25, 0.16), units=SI)
    settings = ScoreSettings(warmup=timedelta(hours=2))
    found = []
    for weights in ((1, 1, 1), (5, 1, 2)):
        frame = tuning.windows_frame(obs, [Window(f"w{i}", 30 * i * HOUR, 30 * (i + 1) * HOUR, weight=w) for i, w in enumerate(weights)])
        bounds = {t: (v / 4, v * 4) for t, v in zip(tuning.TERMS, tuning.of_config(base).values, strict=True)}
        bounds |= {t: (v, v * 4) for t, v in zip(tuning.TERMS, tuning.of_config(base).values, strict=True) if t != "q_inflow"}
        search = tuning.Search(prepare.steps(obs).persist(), base, frame, settings, bounds)
        found.append(tuning.identifiability(search, tuning.of_config(base), 0.05))
    assert found[0]["free"] == ["q_inflow"] and found[0]["standard_errors"]["q_inflow"] == pytest.approx(found[1]["standard_errors"]["q_inflow"], rel=1e-6)


def test_proxy_in_the_tuner(spark):
    obs = spark.createDataFrame(simulate(3, 120), OBS)
    base = SeriesConfig.diagonal(q=(0.005, 0.04, 0.02), r=(0.25, 0.16), units=SI)
    windows = [Window(f"w{i}", a * HOUR, b * HOUR) for i, (a, b) in enumerate(((10, 45), (45, 80), (80, 115)))]
    proxy = obs.select("series", "us", (100 - F.col("us") / HOUR).alias("proxy"))
    out = tuning.tune(obs, base, windows, ScoreSettings(warmup=timedelta(hours=2)), tuning.TuningSettings(evaluations=15, local_searches=1, check_identifiability=False), proxy=proxy, seeds=[10.0, 20.0], version="2")
    assert out["config"].version == "2" and {r.candidate for r in out["proxies"].collect()} == {"base", "search-1"}
    # The proxy is known outside the windows too, but only scored rows are held against it.
    assert all(r.proxy_aligned_count <= 105 for r in out["proxies"].collect())
    assert set(out["config"].metadata["selection"]) >= {"candidate", "objective", "base_objective"}


def test_job_from_exports_to_a_configuration(spark, tmp_path):
    import json

    from catchment.plans.job import tune_exports

    stamp = lambda us: f"{np.datetime64(us, 'us').astype('datetime64[s]')}Z"
    rows = simulate(9, 100)
    kinds = {"storage": [(u, a) for _, u, a, _ in rows], "outlet": [(u, b) for _, u, _, b in rows], "upstream": [(u, 10 + b) for _, u, _, b in rows]}
    for name, values in kinds.items():
        lines = [f"# Location: {name} gauge", "# Value units: x", f"{gauges.TIME},{gauges.VALUE}", *[f"{stamp(u)},{v!r}" for u, v in values], "bad time,1"]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    own = gauges.Sources("lake", *[str(tmp_path / f"{n}.csv") for n in ("storage", "outlet", "upstream")])
    base = SeriesConfig.diagonal(q=(0.005, 0.4, 0.02), r=(0.25, 0.16), units=SI)
    config, report = str(tmp_path / "config.json"), str(tmp_path / "report.json")
    out = tune_exports(spark, own, base, 0, 99 * HOUR, config, "2", report, windows=3, settings=ScoreSettings(warmup=timedelta(hours=2)), tuning=tuning.TuningSettings(evaluations=15, local_searches=1, check_identifiability=False))
    assert json.load(open(config))["version"] == "2" and out["improved"]
    written = json.load(open(report))
    assert {r["name"]: r["timestamp_parse_failures"] for r in written["source_audit"]} == {"storage": 1, "outlet": 1, "upstream": 1}
    assert {r["location"] for r in written["source_audit"]} == {"storage gauge", "outlet gauge", "upstream gauge"}
    assert written["window_audit"][0]["rows"] == 100 and written["window_audit"][0]["requested_end_us"] == 99 * HOUR
    assert written["improvement"] == out["improvement"] and len(written["proxies"]) == 2
    with pytest.raises(ValueError):
        tune_exports(spark, own, base, 0, 1, config, "2", config)


def test_frame_faults_and_hourly_deviations(spark):
    rows = [("a", 1, 1.0, 1.0), ("a", 1, 2.0, 1.0), ("b", 1, 1.0, None), ("b", 2, None, 1.0), (None, 3, 1.0, 1.0)]
    obs = spark.createDataFrame(rows, OBS)
    assert sorted((r.series or "", r.fault) for r in prepare.frame_faults(obs).collect()) == [("", "missing"), ("a", "repeated"), ("b", "too few storage readings")]
    with pytest.raises(ValueError, match="no readings"):
        prepare.checked_frame(obs.limit(0))
    with pytest.raises(ValueError, match="missing"):
        prepare.checked_frame(obs)
    assert units.q_of_hourly_sd(60.0) == 1.0
    assert spark.range(1).select(units.hourly_sd_of_q(F.lit(1.0))).first()[0] == 60.0
    with pytest.raises(ValueError):
        units.q_of_hourly_sd(0)


def test_registered_queries_have_matching_columns(spark, sf):
    import duckdb

    from catchment import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        assert sorted(c[0] for c in con.execute(sql).description) == sorted(queries.QUERIES[name](spark, sf).columns), name


def test_shared_folder(spark):
    assert new_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
