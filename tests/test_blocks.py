"""What a task holds at once doesn't grow with the table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catchment import model_queries, queries
from catchment.operators import estimate, linear, ranks, scores
from catchment.operators.linear import by_groups, filtered_groups


def test_blocks_hold_a_bounded_number_of_rows(spark):
    rows = spark.range(120_000).select((F.col("id") % 400).cast("string").alias("series"), F.lit(0).alias("span"), F.col("id").alias("us")).coalesce(1)

    def work(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(df)], "whole": [bool((df.groupby("series").size() == 300).all())]})

    got = by_groups(rows, ["series", "span"], "us", work, "rows long, whole boolean").collect()
    assert sum(r.rows for r in got) == 120_000 and all(r.whole for r in got)
    # A block, and the batch of Arrow that filled it.
    assert max(r.rows for r in got) <= 30_000


def test_one_group_alone_equals_it_among_others():
    """The stream's short way for a single series, over missing readings and a singular covariance too."""
    rng = np.random.default_rng(4)
    rows, n, k = 40, 3, 2
    y = np.where(rng.random((rows, k)) < 0.3, np.nan, rng.normal(size=(rows, k)))
    f, h = np.eye(n) + 0.1 * rng.normal(size=(rows, n, n)), rng.normal(size=(rows, k, n))
    h[7] = h[7, :1]
    q, r = np.broadcast_to(0.1 * np.eye(n), (rows, n, n)).copy(), np.broadcast_to(0.2 * np.eye(k), (rows, k, k)).copy()
    r[7] = 0
    inputs = (y, f, q, h, r)
    alone = filtered_groups(np.zeros((1, n)), np.eye(n)[None].copy(), inputs, np.array([0]), np.array([rows]))
    twice = tuple(np.concatenate([x, x]) for x in inputs)
    both = filtered_groups(np.zeros((2, n)), np.stack([np.eye(n)] * 2), twice, np.array([0, rows]), np.array([rows, rows]))
    for a, b in zip(alone, both, strict=True):
        np.testing.assert_allclose(a, b[:rows], rtol=1e-9, atol=1e-12)


def test_a_stream_batch_is_filtered_without_a_loop_over_groups(monkeypatch):
    """One series isn't taken as an array of one, which costs several times the work."""
    monkeypatch.setattr(linear, "in_step", None)
    inputs = (np.zeros((5, 1)), np.ones((5, 1, 1)), np.ones((5, 1, 1)), np.ones((5, 1, 1)), np.ones((5, 1, 1)))
    assert len(linear.filtered_groups(np.zeros((1, 1)), np.ones((1, 1, 1)), inputs, np.array([0]), np.array([5]))[0]) == 5


def test_scores_write_only_the_columns_that_are_read_again(spark, sf, monkeypatch):
    """The metrics' tables are written once and narrow; warnings need no quantiles, so none are ranked for them."""
    wrote, built = [], []

    def noted(module):
        own = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name="stage": (wrote.append((name, tuple(df.columns))), own(df, name))[1])

    for module in (scores, estimate, ranks):
        noted(module)
    own = queries.event_observations
    monkeypatch.setattr(queries, "event_observations", lambda *a: (built.append(a), own(*a))[1])
    warned = queries.calibration_warnings(spark, sf)
    assert {name for name, _ in wrote} == {"steps", "states"} and ("states", scores.READS) in wrote and len(built) == 1
    assert warned.count() > 0
    queries.pooled_metrics(spark, sf)
    assert ("changes", ("series", "change")) in wrote and len(built) == 2


def test_tuning_reads_hourly_sums_and_not_the_events_each_time(spark, sf):
    """What is scored and tuned is a written table of one row an hour and series, whatever the number of events."""
    readings = model_queries._hourly_readings(spark, sf)
    assert readings.count() > 0 and not any("events.parquet" in f for f in readings.inputFiles())
