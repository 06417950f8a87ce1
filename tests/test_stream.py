from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest

from catchment.functions.units import SI
from catchment.operators.estimate import estimate
from catchment.plans.config import SeriesConfig
from catchment.sources.shared import new_dir
from catchment.operators.estimate import states
from catchment.operators.filtering import smoothed
from catchment.operators.linear import Given
from catchment.streaming.inflow import pending_counts, provisional, stream_estimates, stream_states

SCHEMA = "series string, us long, storage double, outflow double"
CONFIG = SeriesConfig.diagonal(lag=timedelta(hours=3), units=SI)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    out = []
    for s in "ab":
        us = np.cumsum(rng.integers(10**6, 5400 * 10**6, size=40)).tolist()
        for i, u in enumerate(us):
            storage = None if i == 0 or (i > 3 and rng.random() < 0.25) else float(100 + rng.normal())
            outflow = None if i > 3 and rng.random() < 0.25 else float(4 + rng.normal())
            out.append((s, int(u), storage, outflow))
    return sorted(out, key=lambda r: r[1])


def run(spark, folder, out, check, config=CONFIG):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = stream_estimates(stream, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch_across_restarts(spark):
    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
    rows = rows_of(4)
    for a, b in ((0, 1), (1, 3), (3, 30), (30, 31), (31, 80)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, out, check)
    late = [("a", rows[10][1], 1.0, 1.0), ("new", 5, 3.0, None)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, out, check)
    got = spark.read.parquet(out).collect()
    batch = {(r.series, r.us): r for r in estimate(spark.createDataFrame(rows, SCHEMA), CONFIG, uncertainty=True).collect()}
    causal = {(r.series, r.us): r for r in got if r.kind == "filtered"}
    revised = {(r.series, r.us): r for r in got if r.kind == "revised"}
    assert set(causal) == {k for k, r in batch.items() if r.estimated_inflow is not None}
    assert set(revised) == {k for k, r in batch.items() if r.revised_inflow is not None}
    for k, r in causal.items():
        assert r.value == pytest.approx(batch[k].estimated_inflow, abs=1e-8) and r.prediction_flag == batch[k].estimated_inflow_flag
        assert r.standard_deviation == pytest.approx(batch[k].estimated_inflow_standard_deviation, abs=1e-8)
    for k, r in revised.items():
        assert r.value == pytest.approx(batch[k].revised_inflow, abs=1e-7) and r.smoothing_flag == "SMOOTHED"
    assert sorted(r.series for r in got if r.kind == "rejected") == ["a", "new"]


def test_another_model_is_refused(spark):
    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
    spark.createDataFrame(rows_of(1)[:10], SCHEMA).coalesce(1).write.parquet(folder)
    run(spark, folder, out, check)
    spark.createDataFrame(rows_of(1)[10:20], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="another configuration"):
        run(spark, folder, out, check, SeriesConfig.diagonal(q=(1, 1, 1), lag=timedelta(hours=3), units=SI))


def test_what_waits_in_a_stopped_stream(spark):
    """Provisional values and counts at several stops equal the batch's at that time."""
    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
    rows = rows_of(7)
    for a, b in ((0, 9), (9, 50), (50, 80)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, out, check)
        known = states(spark.createDataFrame(rows[:b], SCHEMA), CONFIG)
        want = {(r.series, r.us): r for r in smoothed(known, CONFIG, provisional=True).filter("NOT released").collect()}
        got = {(r.series, r.us): r for r in provisional(spark, check, CONFIG).collect()}
        assert set(got) == set(want) and got
        for k, r in got.items():
            assert r.value == pytest.approx(want[k].sm1, abs=1e-7) and r.standard_deviation == pytest.approx(want[k].sp11 ** 0.5, abs=1e-7)
        assert {r.series: r.pending for r in pending_counts(spark, check).collect()} == {s: sum(k[0] == s for k in want) for s in {k[0] for k in want}}


def logged_bytes(check):
    """Bytes of the state store's change logs, by version."""
    import glob
    import os

    sizes: dict = {}
    for path in glob.glob(check.removeprefix("file://") + "/state/0/*/*.changelog"):
        version = int(os.path.basename(path).split(".")[0].split("_")[0])
        sizes[version] = sizes.get(version, 0) + os.path.getsize(path)
    return sizes


def test_a_batch_writes_what_it_changes(spark):
    """One more reading a series costs the same whether 20 or 400 wait, and a waiting reading about 24 bytes."""
    minute, sizes = 60_000_000, {}
    for waiting in (20, 400):
        folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
        for a, b in ((0, waiting), (waiting, waiting + 1)):
            rows = [(f"s{k}", i * minute // 10, 100.0 + i % 7, 4.0) for k in range(20) for i in range(a, b)]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            run(spark, folder, out, check)
        sizes[waiting] = logged_bytes(check)
    first = {k: min(v.items())[1] / 20 for k, v in sizes.items()}
    last = {k: max(v.items())[1] / 20 for k, v in sizes.items()}
    assert last[400] < 1.1 * last[20] and first[400] - first[20] < 380 * 26


def test_a_model_of_ones_own_in_a_stream(spark):
    """A walk that is read directly: no start rule, so each row has a state at once."""
    model = Given(("y",), [[1.0]], [[1.0]], [[1.0]], [[1.0]], [0.0], [[4.0]])
    folder, out, check = (new_dir(spark, n) for n in ("in", "out", "check"))
    spark.createDataFrame([("a", 0, 2.0), ("a", 10, 2.5), ("a", 20, None)], "series string, us long, y double").write.parquet(folder)
    stream = spark.readStream.schema("series string, us long, y double").parquet(folder)
    stream_states(stream, model, 15, 0, "walk").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = {(r.us, r.kind): r.value for r in spark.read.parquet(out).collect()}
    assert got[0, "filtered"] == pytest.approx(1.6) and got[10, "filtered"] == pytest.approx(2.17857143) == got[20, "filtered"]
    # Smoothed from the last row, which has no reading: 1.6 + 0.8 / 1.8 (2.17857143 - 1.6).
    assert got[0, "revised"] == pytest.approx(1.6 + 0.8 / 1.8 * (2.17857143 - 1.6)) and (10, "revised") not in got
