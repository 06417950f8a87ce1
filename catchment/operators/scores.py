"""How well innovations fit their predicted spread: per row, per window, and pooled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, correlation, span_of, with_previous
from ..plans.config import ScoreSettings
from ..sources.shared import staged
from .linear import by_groups, groups_of
from .prepare import elapsed_seconds, in_windows
from .ranks import quantiles

# Half-widths of central intervals of a standard normal, in deviations.
CENTRAL = {50: 0.6744897501960817, 90: 1.6448536269514722}
LOG_TWO_PI = math.log(2 * math.pi)
CHANNELS = ("storage", "outflow", "conditional_storage")
MATERIAL = "max_material_elapsed_lag_autocorrelation"
#: The columns of filtered states that row_scores and the metrics read.
READS = ("series", "us", "second_us", "m1", "v0", "v1", "s00", "s01", "s11", "log_density")
#: Lags of one series at most.
MOST_LAGS = 100_000
#: A 2 x 2 covariance nearer to singular than this is not scored.
PIVOT = 1e-10


def density(quad: Column, log_det: Column, n: int) -> Column:
    """Negative logarithm of a normal density of n components."""
    return 0.5 * (n * F.lit(LOG_TWO_PI) + log_det + quad)


def row_scores(states: DataFrame) -> DataFrame:
    """states (see filtering.filtered) with the scores of each row that was read, in built-in expressions.

    joint_nlpd and joint_nis over the components read (joint_components), storage_nlpd of storage given
    the outflow of the row (or alone), z and nis of storage, outflow and conditional storage. A
    row whose covariance isn't safely positive definite has no scores but joint_nlpd, from the raised covariance (see linear.log_density), and is
    unscorable if it has none of that either.
    """
    a, b, c, v0, v1 = (F.col(x) for x in ("s00", "s01", "s11", "v0", "v1"))
    storage, outflow = v0.isNotNull(), v1.isNotNull()
    schur, other = a - b * b / c, c - b * b / a
    safe = (a > 0) & (c > 0) & (schur > PIVOT * a) & (other > PIVOT * c)
    both, one, two = storage & outflow & safe, storage & ~outflow & (a > 0), ~storage & outflow & (c > 0)
    conditional = v0 - b * v1 / c
    quad = v0 * v0 / a + (v1 - b * v0 / a) * (v1 - b * v0 / a) / other
    z_storage, z_outflow, z_conditional = F.when(both | one, v0 / F.sqrt(a)), F.when(both | two, v1 / F.sqrt(c)), F.when(both, conditional / F.sqrt(schur))
    scored = states.withColumns(
        {
            "joint_components": storage.cast("int") + outflow.cast("int"),
            "joint_nis": F.when(both, quad).when(one, v0 * v0 / a).when(two, v1 * v1 / c),
            "joint_nlpd": F.when(both, density(quad, F.log(a * other), 2)).when(one, density(v0 * v0 / a, F.log(a), 1)).when(two, density(v1 * v1 / c, F.log(c), 1)).when(storage | outflow, -F.col("log_density")),
            "storage_nlpd": F.when(both, density(conditional * conditional / schur, F.log(schur), 1)).when(one, density(v0 * v0 / a, F.log(a), 1)),
            "storage_z": z_storage,
            "outflow_z": z_outflow,
            "conditional_storage_z": z_conditional,
            "unscorable": (storage | outflow) & F.col("log_density").isNull(),
        }
    )
    return scored.withColumns({f"{n}_nis": F.col(f"{n}_z") * F.col(f"{n}_z") for n in ("storage", "outflow", "conditional_storage")})


def scored_rows(scores: DataFrame, warmup_us: int) -> DataFrame:
    """Rows that count: behind both rows that start the series, and at least the warm-up after the second."""
    return scores.filter((F.col("us") > F.col("second_us")) & (F.col("us") >= F.col("second_us") + warmup_us))


def _window_metrics() -> list[Column]:
    mean = lambda c, name: F.avg(c).alias(name)
    parts = F.sum(F.when(F.col("joint_nlpd").isNotNull(), F.col("joint_components")))
    return [
        mean("storage_nlpd", "storage_nlpd"),
        F.count("storage_nlpd").alias("storage_count"),
        (F.sum("joint_nlpd") / parts).alias("joint_nlpd"),
        F.coalesce(parts, F.lit(0)).cast("long").alias("joint_count"),
        (F.sum("joint_nis") / parts).alias("joint_nis"),
        mean("storage_nis", "storage_nis"),
        mean("outflow_nis", "outflow_nis"),
        mean("conditional_storage_nis", "conditional_storage_nis"),
        mean("storage_z", "storage_bias"),
        mean("outflow_z", "outflow_bias"),
        mean("conditional_storage_z", "conditional_storage_bias"),
        (F.count("storage_nlpd") / F.count("*")).alias("scored_fraction"),
        F.count_if("unscorable").alias("unscorable_count"),
    ]


def window_scores(scores: DataFrame, windows: DataFrame, settings: ScoreSettings | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per series (and `by`) and window: mean scores, counts, biases. Windows without counted rows have zero counts."""
    settings = settings or ScoreSettings()
    rows = in_windows(scored_rows(scores, _us(settings.warmup)), windows)
    found = rows.groupBy("series", *by, "name").agg(*_window_metrics())
    keys = windows.select("series", "name", "start_us", "end_us")
    if by:
        keys = keys.join(scores.select("series", *by).distinct(), "series")
    full = keys.join(found, ["series", *by, "name"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("storage_count", "joint_count", "unscorable_count")} | {"scored_fraction": F.coalesce("scored_fraction", F.lit(0.0))})


def validity(window_rows: DataFrame, settings: ScoreSettings | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(series, by..., reasons): why a candidate can't be used; an empty list if it can."""
    least = (settings or ScoreSettings()).least_scored
    few = F.when(F.col("storage_count") < least, F.concat("name", F.lit(f" has fewer than {least} scored storage readings")))
    odd = F.when(F.col("joint_nlpd").isNull() | F.isnan("joint_nlpd"), F.concat("name", F.lit(" has no finite joint density")))
    bad = F.when(F.col("unscorable_count") > 0, F.concat("name", F.lit(" has rows without a positive definite covariance")))
    reasons = F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(few, odd, bad)))))
    return window_rows.groupBy("series", *by).agg(reasons.alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def pooled_metrics(scores: DataFrame, windows: DataFrame, settings: ScoreSettings | None = None, span: int = SPAN_US) -> DataFrame:
    """One row per series over all counted rows in its windows: inflow behaviour, biases, NIS, coverage and prediction errors."""
    settings = settings or ScoreSettings()
    rows = in_windows(scored_rows(scores, _us(settings.warmup)).select("series", "us", "m1"), windows)
    timed = with_previous(rows.drop("name"), "series", ["m1"], "before", span)
    change = (F.col("m1") - F.col("before.m1")) / elapsed_seconds(F.col("us"), F.col("before.us"))
    # The quantiles read their rows more than once; they need nothing but these two columns.
    changes = staged(timed.select("series", change.alias("change")).filter("change IS NOT NULL"), "changes")
    sizes = changes.select("series", F.abs("change").alias("size"))
    middle = quantiles(changes, ["series"], "change", {"inflow_change_median_per_second": 0.5}).join(quantiles(sizes, ["series"], "size", {"inflow_change_q95_per_second": 0.95}), "series", "full")
    return calibration_metrics(scores, windows, settings).join(middle, "series", "left")


def calibration_metrics(scores: DataFrame, windows: DataFrame, settings: ScoreSettings | None = None) -> DataFrame:
    """pooled_metrics without the quantiles of the inflow's changes: all that calibration_warnings checks, by one aggregate over the rows."""
    settings = settings or ScoreSettings()
    zs = [f"{c}_z" for c in CHANNELS]
    rows = in_windows(scored_rows(scores, _us(settings.warmup)).select("series", "us", "m1", "v0", "joint_components", "joint_nis", *zs, *[f"{c}_nis" for c in CHANNELS]), windows)
    cover = [F.avg((F.abs(F.col(f"{c}_z")) <= z).cast("int")).alias(f"{c}_coverage_{level}") for c in ("storage", "outflow") for level, z in CENTRAL.items()]
    parts = F.sum(F.when(F.col("joint_nis").isNotNull(), F.col("joint_components")))
    return rows.groupBy("series").agg(
        F.avg((F.col("m1") < 0).cast("int")).alias("negative_inflow_frequency"),
        F.avg("storage_z").alias("storage_bias"),
        F.avg("outflow_z").alias("outflow_bias"),
        F.avg("conditional_storage_z").alias("conditional_storage_bias"),
        (F.sum("joint_nis") / parts).alias("joint_nis"),
        F.avg("storage_nis").alias("storage_nis"),
        F.avg("outflow_nis").alias("outflow_nis"),
        F.avg("conditional_storage_nis").alias("conditional_storage_nis"),
        F.var_samp("storage_nis").alias("storage_nis_variance"),
        F.var_samp("outflow_nis").alias("outflow_nis_variance"),
        *cover,
        F.sqrt(F.avg(F.when(F.col("storage_z").isNotNull(), F.col("v0") * F.col("v0")))).alias("causal_storage_prediction_rmse"),
        F.avg(F.when(F.col("storage_z").isNotNull(), F.col("v0"))).alias("causal_storage_prediction_bias"),
    )


def autocorrelation(rows: DataFrame, value: str, lags: list[int] | DataFrame, tolerance_us: int | None = None, span: int = SPAN_US, transforms: bool = True) -> DataFrame:
    """(series, lag_us, autocorrelation, pair_count) of rows(series, us, value) over all pairs whose distance is lag +- tolerance, both ends included.

    lags are the same for all series, or (series, lag_us, tolerance_us) rows as cadence_lags gives. Values are centred on their
    series' mean; a bin's covariance is divided by the root of both sides' energies; under three pairs, or without energy, it is
    null. Series whose values are evenly spaced, at lags that are multiples of the spacing with a tolerance below it, go by Fourier transforms
    of overlapping spans (transforms: whether they may), so their work hardly grows with the lags; the others by pairs, which meet in buckets of time as wide as the tolerance reaches.
    """
    seen = staged(rows.filter(F.col(value).isNotNull()).select("series", "us", F.col(value).alias("x")), "values")
    known = seen.groupBy("series").agg(F.avg("x").alias("mean"))
    if isinstance(lags, DataFrame):
        known = known.join(lags.groupBy("series").agg(F.array_sort(F.collect_set("lag_us")).alias("lags"), F.max("tolerance_us").alias("tolerance")), "series")
    else:
        known = known.withColumns({"lags": F.array(*[F.lit(x).cast("long") for x in lags]), "tolerance": F.lit(tolerance_us).cast("long")})
    gaps = with_previous(seen, "series", ["us"], "before", span).select("series", (F.col("us") - F.col("before.us")).alias("gap")).groupBy("series").agg(F.min("gap").alias("gap"), F.max("gap").alias("widest"))
    even = F.lit(transforms) & (F.col("gap") == F.col("widest")) & (F.col("tolerance") < F.col("gap")) & F.forall("lags", lambda x: (x > 0) & (F.try_mod(x, F.col("gap")) == 0))
    known = staged(known.join(gaps, "series").withColumn("even", F.coalesce(even, F.lit(False))), "series")
    centred = seen.join(known, "series").select("series", "us", (F.col("x") - F.col("mean")).alias("x"), "lags", "tolerance", "gap", "even")
    sums = _pair_sums(centred.filter("NOT even")).unionByName(_transform_sums(centred.filter("even"), span))
    every = known.select("series", F.explode("lags").alias("lag_us"))
    power = F.sqrt(F.col("e0") * F.col("e1"))
    return every.join(sums, ["series", "lag_us"], "left").select("series", "lag_us", F.when((F.col("pair_count") >= 3) & (power > 0), F.col("c") / power).alias("autocorrelation"), F.coalesce("pair_count", F.lit(0)).alias("pair_count"))


_SUMS = ("pair_count", "c", "e0", "e1")


def _pair_sums(centred: DataFrame) -> DataFrame:
    """(series, lag_us, pair_count, c, e0, e1): number of pairs, sum of their products, and of both sides' squares, by meeting in buckets."""
    width = 2 * F.col("tolerance") + 1
    sources = centred.select("series", F.col("us").alias("us0"), F.col("x").alias("x0"), "tolerance", F.explode("lags").alias("lag_us"))
    low = F.floor((F.col("us0") + F.col("lag_us") - F.col("tolerance")) / width).cast("long")
    aimed = sources.withColumn("bucket", F.explode(F.array(low, low + 1)))
    targets = centred.select("series", "us", "x", F.floor(F.col("us") / width).cast("long").alias("bucket"))
    near = F.abs(F.col("us") - F.col("us0") - F.col("lag_us")) <= F.col("tolerance")
    pairs = aimed.join(targets, ["series", "bucket"]).filter(near & (F.col("us") > F.col("us0")))
    return pairs.groupBy("series", "lag_us").agg(F.count("*").alias("pair_count"), F.sum(F.col("x0") * F.col("x")).alias("c"), F.sum(F.col("x0") * F.col("x0")).alias("e0"), F.sum(F.col("x") * F.col("x")).alias("e1"))


def _transform_sums(centred: DataFrame, span: int) -> DataFrame:
    """The same for evenly spaced series: each span's rows against themselves and the rows behind them as far as the longest lag, by one transform a span."""
    at = span_of("us", span)
    reach = F.floor((F.col("us") - F.element_at("lags", -1)) / F.lit(span)).cast("long")
    placed = centred.select("series", "us", "x", "gap", F.element_at("lags", -1).alias("reach"), at.alias("at"), F.explode(F.sequence(reach, at)).alias("span"))

    def work(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        start, size = groups_of(df, ["series", "span"])
        for a, k in zip(start, size, strict=True):
            part = df.iloc[a : a + k]
            own = int((part["at"] == part["span"]).sum())
            if own:
                gap = int(part["gap"].iloc[0])
                most = min(int(part["reach"].iloc[0]) // gap, k - 1)
                out.append(lagged_sums(part["x"].to_numpy(dtype=float), own, most).assign(series=part["series"].iloc[0], gap=gap))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["steps", *_SUMS, "series", "gap"])
        return found.assign(lag_us=found["steps"] * found["gap"])[["series", "lag_us", *_SUMS]]

    found = by_groups(placed, ["series", "span"], "us", work, "series string, lag_us long, pair_count long, c double, e0 double, e1 double")
    return found.groupBy("series", "lag_us").agg(*[F.sum(c).alias(c) for c in _SUMS])


def lagged_sums(x: np.ndarray, own: int, most: int) -> pd.DataFrame:
    """(steps, pair_count, c, e0, e1) for 1 .. most steps between a value among the first `own` and one behind it, by a Fourier transform."""
    size = 1 << int(own + len(x) - 1).bit_length()
    c = np.fft.irfft(np.conj(np.fft.rfft(x[:own], size)) * np.fft.rfft(x, size), size)
    steps = np.arange(1, most + 1)
    pairs = np.minimum(own, len(x) - steps)
    energy = np.append(0.0, np.cumsum(x * x))
    return pd.DataFrame({"steps": steps, "pair_count": pairs, "c": c[steps], "e0": energy[pairs], "e1": energy[steps + pairs] - energy[steps]})


def cadence_lags(rows: DataFrame, max_lag_us: int, span: int = SPAN_US, most: int = MOST_LAGS) -> DataFrame:
    """(series, lag_us, tolerance_us): multiples of a series' shortest interval up to max_lag_us, and a quarter of it, a second at least.

    Each series has lags of its own; one that needs over `most` of them is an error that names it. Series of fewer than two times have none.
    """
    gaps = with_previous(rows.select("series", "us"), "series", ["us"], "before", span).select("series", (F.col("us") - F.col("before.us")).alias("gap"))
    least = gaps.filter("gap > 0").groupBy("series").agg(F.min("gap").alias("gap")).withColumn("end", F.expr(f"{max_lag_us}L + (gap + 1) div 2 - 1"))
    many = F.raise_error(F.concat(F.lit(f"over {most} lags in series "), F.col("series"))).cast("long")
    checked = least.withColumn("end", F.when(F.expr(f"end div gap > {most}"), many).otherwise(F.col("end"))).filter("end >= gap")
    return checked.select("series", F.explode(F.sequence("gap", "end", "gap")).alias("lag_us"), F.greatest(F.expr("gap div 4"), F.lit(1_000_000)).alias("tolerance_us"))


def positional_lags(rows: DataFrame, estimate: str, upstream: str, lags: list[int]) -> DataFrame:
    """(series, lag, correlation, pair_count): Pearson's correlation of estimate with upstream `lag` rows earlier (later, if negative), whatever time lies between.

    Rows without a value keep their place; a pair needs both; under two pairs, or for a constant side, the correlation is null.
    One window per series, so a series is one task: meant for evenly spaced frames, as rows stand for time there.
    """
    order = Window.partitionBy("series").orderBy("us")
    pairs = rows.select("series", F.col(estimate).alias("x"), *[F.lag(upstream, k).over(order).alias(f"y{i}") for i, k in enumerate(lags)])
    flat = pairs.select("series", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{i}").alias("y")) for i, k in enumerate(lags)])).alias("p")).select("series", "x", "p.*")
    return flat.groupBy("series", "lag").agg(correlation("x", "y").alias("correlation"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("pair_count"))


def autocorrelation_metrics(scores: DataFrame, windows: DataFrame, settings: ScoreSettings | None = None, span: int = SPAN_US) -> DataFrame:
    """(series, max_{channel}_elapsed_lag_autocorrelation and _seconds for each channel, max_material_elapsed_lag_autocorrelation).

    Over the counted rows in a series' windows: for the deviations z of storage, outflow and conditional storage, the largest absolute
    autocorrelation at a multiple of the series' own cadence, and its lag; the material one is the largest of the three.
    """
    settings = settings or ScoreSettings()
    rows = in_windows(scored_rows(scores, _us(settings.warmup)), windows)
    lags = cadence_lags(rows, _us(settings.max_lag), span)
    out = rows.select("series").distinct()
    names = []
    for channel in CHANNELS:
        best = largest_autocorrelation(autocorrelation(rows, f"{channel}_z", lags))
        names.append(f"max_{channel}_elapsed_lag_autocorrelation")
        out = out.join(best.select("series", F.col("largest").alias(names[-1]), (F.col("lag_us") / 1e6).alias(f"max_{channel}_elapsed_lag_seconds")), "series", "left")
    return out.withColumn(MATERIAL, F.greatest(*names))


def largest_autocorrelation(found: DataFrame) -> DataFrame:
    """(series, largest, lag_us): the lag whose autocorrelation is farthest from zero, the shortest of equal ones."""
    best = F.max_by(F.struct("autocorrelation", "lag_us"), F.struct(F.abs("autocorrelation"), -F.col("lag_us")))
    return found.filter("autocorrelation IS NOT NULL").groupBy("series").agg(best.alias("b")).select("series", F.abs("b.autocorrelation").alias("largest"), F.col("b.lag_us").alias("lag_us"))


def calibration_warnings(pooled: DataFrame, settings: ScoreSettings | None = None) -> DataFrame:
    """(series, metric, value, low, high) for each metric that is missing or outside its range; the autocorrelation only if pooled has it (see autocorrelation_metrics)."""
    s = settings or ScoreSettings()
    checks: list[tuple[str, float, float]] = []
    if s.nis_range:
        checks += [(m, *s.nis_range) for m in ("joint_nis", "storage_nis", "outflow_nis")]
    if s.bias_limit is not None:
        checks += [(m, -s.bias_limit, s.bias_limit) for m in ("storage_bias", "outflow_bias", "conditional_storage_bias")]
    if s.coverage_limit is not None:
        checks += [(f"{c}_coverage_{level}", level / 100 - s.coverage_limit, level / 100 + s.coverage_limit) for c in ("storage", "outflow") for level in CENTRAL]
    if s.autocorrelation_limit is not None and MATERIAL in pooled.columns:
        checks.append((MATERIAL, 0.0, s.autocorrelation_limit))
    if not checks:
        return pooled.select("series", F.lit("").alias("metric"), F.lit(0.0).alias("value"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(a).alias("low"), F.lit(b).alias("high")) for m, a, b in checks]))
    return pooled.select("series", each.alias("x")).select("series", "x.*").filter("value IS NULL OR value < low OR value > high")


def _us(span) -> int:
    return int(span.total_seconds() * 1_000_000)
