"""Places, parts, ranks, quantiles and windows that no single task has to hold, against pandas."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catchment.operators.prepare import in_windows
from catchment.operators.ranks import average_ranks, equal_part, quantiles, ranked


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "cold", None], 3000), "x": rng.integers(0, 60, 3000).astype(float), "id": np.arange(3000)})
    frame.loc[frame.index % 17 == 0, "x"] = np.nan
    rows = spark.createDataFrame([(g, None if np.isnan(x) else float(x), int(i)) for g, x, i in frame.itertuples(index=False)], "g string, x double, id long")
    return frame, rows.repartition(7).persist()


def test_places(values):
    frame, rows = values
    got = ranked(rows, ["g"], [F.desc_nulls_last("x"), "id"], "pos", "size").toPandas()
    assert len(got) == len(frame)
    for _, part in got.groupby(got.g.fillna("-")):
        want = part.sort_values(["x", "id"], ascending=[False, True])
        assert want.pos.tolist() == list(range(len(part))) and (part["size"] == len(part)).all()


def test_a_hot_group_is_dealt_over_ranges(spark, values):
    _, rows = values
    out = ranked(rows.filter("g = 'hot'"), ["g"], ["x", "id"])
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_equal_parts_are_ntile(spark):
    for n, k in ((20, 6), (60, 6), (7, 3), (13, 5), (2, 5), (5, 5)):
        rows = spark.range(n).select(F.col("id").alias("pos"), F.lit(n).cast("long").alias("size"))
        got = [r.p for r in rows.select("pos", equal_part("pos", "size", k).alias("p")).orderBy("pos").collect()]
        assert got == [i + 1 for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]


def test_average_ranks_and_quantiles(values):
    frame, rows = values
    ranks = {(r.g, r.x): r["rank"] for r in average_ranks(rows, ["g"], "x").filter("g IS NOT NULL").collect()}
    found = {r.g: r for r in quantiles(rows, ["g"], "x", {"low": 0.05, "middle": 0.5, "high": 0.95, "top": 1.0}).collect()}
    for g in ("hot", "cold"):
        x = frame[(frame.g == g) & frame.x.notna()].x
        want = x.rank()
        assert {(g, a): b for a, b in zip(x, want, strict=True)} == {k: v for k, v in ranks.items() if k[0] == g}
        assert [found[g].low, found[g].middle, found[g].high, found[g].top] == pytest.approx(x.quantile([0.05, 0.5, 0.95, 1.0]).tolist())
    assert ranked(rows.limit(0), ["g"], ["x"]).count() == 0 and quantiles(rows.limit(0), ["g"], "x", {"m": 0.5}).count() == 0


def test_windows_of_all_lengths_hold_what_they_hold(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 3}", int(u)) for i, u in enumerate(rng.integers(-(10**6), 10**7, 800))]
    windows = [(f"s{rng.integers(4)}", f"w{k}", int(a := rng.integers(-(10**6), 10**7)), int(a + rng.choice([1, 50, 3000, 10**6, 2**40]))) for k in range(60)]
    windows += [("s0", "all", -(2**62), 2**62), ("s1", "empty", 5, 5), ("s1", "far", 2**60, 2**61)]
    got = in_windows(spark.createDataFrame(rows, "series string, us long"), spark.createDataFrame(windows, "series string, name string, start_us long, end_us long"))
    want = sorted((s, u, n) for s, u in rows for t, n, a, b in windows if s == t and a <= u < b)
    assert sorted((r.series, r.us, r.name) for r in got.collect()) == want
    kept = in_windows(spark.createDataFrame(rows, "series string, us long"), spark.createDataFrame(windows, "series string, name string, start_us long, end_us long"), bounds=True, most=12)
    assert sorted((r.series, r.us, r.name) for r in kept.collect()) == want and {"start_us", "end_us"} <= set(kept.columns)


def test_many_windows_cost_about_what_few_do(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("s").alias("series"), (F.col("id") * 1000).alias("us")).persist()
    rows.count()

    def seconds(count):
        width = n * 1000 // count
        windows = spark.createDataFrame([("s", f"w{i}", i * width, (i + 1) * width) for i in range(count)], "series string, name string, start_us long, end_us long").persist()
        windows.count()
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            assert in_windows(rows, windows).count() == n // count * count
            runs.append(time.perf_counter() - began)
        return min(runs)

    few = seconds(4)
    assert seconds(1000) < 3 * few + 1
