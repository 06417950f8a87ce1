"""Tables that check an estimate: a regular clock, agreement with an upstream gauge, lags, storage closure and behaviour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, correlation, finite, ratio, span_of, with_previous
from ..functions.units import US
from ..sources.shared import staged
from .prepare import elapsed_seconds
from .ranks import average_ranks

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
ESTIMATES = ("raw_inflow", "centered_rolling_inflow", "estimated_inflow", "delayed_revised_inflow")
# Other names that a column may come with.
ALIASES = {"trailing_rolling_inflow": "centered_rolling_inflow", "revised_inflow": "delayed_revised_inflow", "upstream": "upstream_flow", "rolling_inflow": "centered_rolling_inflow"}


@dataclass(frozen=True)
class ValidationSettings:
    frequency_us: int = HOUR_US
    lag_range: int = 48
    least_pairs: int = 3
    rolling_us: int = 6 * HOUR_US
    training: tuple[int | None, int | None] = (None, None)
    evaluation: tuple[int | None, int | None] = (None, None)
    factor: float = US.flow_to_volume_per_second

    def __post_init__(self):
        if self.frequency_us <= 0 or self.rolling_us <= 0 or self.lag_range < 0 or self.least_pairs < 2 or self.factor <= 0:
            raise ValueError("settings out of range")
        for a, b in (self.training, self.evaluation):
            if a is not None and b is not None and a > b:
                raise ValueError("a period ends before it starts")

    @property
    def evaluated(self) -> tuple[int | None, int | None]:
        """The evaluation period; behind the training period where only that is given."""
        start, end = self.evaluation
        if start is None and self.training[1] is not None:
            start = self.training[1] + self.frequency_us
        return start, end


def raw_balance(rows: DataFrame, factor: float = US.flow_to_volume_per_second, span: int = SPAN_US) -> DataFrame:
    """rows(series, us, storage, outflow, ...) with raw_inflow: the storage gained since the row before as a flow, plus that row's outflow."""
    timed = with_previous(rows, "series", ["storage", "outflow"], "before", span)
    dt = elapsed_seconds(F.col("us"), F.col("before.us"))
    return timed.withColumn("raw_inflow", F.when(dt > 0, (F.col("storage") - F.col("before.storage")) / (dt * factor)) + F.col("before.outflow")).drop("before")


def regular(rows: DataFrame, columns: list[str], frequency_us: int = HOUR_US) -> DataFrame:
    """(series, us, columns): means over bins of frequency_us, which start at midnight of the series' first day.

    Every bin from the first to the last is there; a bin or column without a value is null.
    """
    ends = rows.groupBy("series").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    origin = F.floor(F.col("first") / F.lit(DAY_US)).cast("long") * DAY_US
    bin_of = lambda c: F.floor((F.col(c) - origin) / F.lit(frequency_us)).cast("long")
    means = rows.join(ends, "series").withColumn("us", origin + bin_of("us") * frequency_us).groupBy("series", "us").agg(*[F.avg(finite(c)).alias(c) for c in columns])
    bins = ends.withColumn("bin", F.explode(F.sequence(bin_of("first"), bin_of("last"))))
    clock = bins.select("series", (origin + F.col("bin") * frequency_us).alias("us"))
    return clock.join(means, ["series", "us"], "left")


def rolling_mean(rows: DataFrame, column: str, window_us: int, name: str, span: int = SPAN_US) -> DataFrame:
    """rows with the mean of column over (us - window / 2, us + window / 2], nulls left out; rows near a span's edge are copied across."""
    half = window_us // 2
    spread = F.explode(F.sequence(F.floor((F.col("us") - half) / F.lit(span)).cast("long"), F.floor((F.col("us") + half) / F.lit(span)).cast("long")))
    copies = rows.select("series", "us", column, span_of("us", span).alias("__own"), spread.alias("__span"))
    frame = Window.partitionBy("series", "__span").orderBy("us").rangeBetween(-(half - 1), half)
    means = copies.withColumn(name, F.avg(column).over(frame)).filter("__own = __span").select("series", "us", name)
    return rows.join(means, ["series", "us"], "left")


def validation_frame(comparison: DataFrame, settings: ValidationSettings | None = None) -> DataFrame:
    """(series, us, storage, outflow, raw_inflow, centered_rolling_inflow, estimated_inflow, delayed_revised_inflow, upstream_flow) on a regular clock.

    raw_inflow and centered_rolling_inflow are computed unless given; ALIASES are accepted.
    """
    s = settings or ValidationSettings()
    for old, new in ALIASES.items():
        if old in comparison.columns and new not in comparison.columns:
            comparison = comparison.withColumnRenamed(old, new)
    need = {"series", "us", "storage", "outflow", "estimated_inflow", "delayed_revised_inflow", "upstream_flow"} - set(comparison.columns)
    if need:
        raise ValueError(f"comparison lacks {', '.join(sorted(need))}")
    if "raw_inflow" not in comparison.columns:
        comparison = raw_balance(comparison, s.factor)
    columns = ["storage", "outflow", "raw_inflow", "estimated_inflow", "delayed_revised_inflow", "upstream_flow"]
    given = "centered_rolling_inflow" in comparison.columns
    frame = regular(comparison, columns + ["centered_rolling_inflow"] * given, s.frequency_us)
    if not given:
        frame = rolling_mean(frame, "raw_inflow", s.rolling_us, "centered_rolling_inflow")
    return frame.select("series", "us", "storage", "outflow", "raw_inflow", "centered_rolling_inflow", "estimated_inflow", "delayed_revised_inflow", "upstream_flow")


def between(rows: DataFrame, period: tuple[int | None, int | None]) -> DataFrame:
    """rows with period[0] <= us <= period[1]; a bound of None is none."""
    for bound, keep in zip(period, (lambda b: F.col("us") >= b, lambda b: F.col("us") <= b), strict=True):
        if bound is not None:
            rows = rows.filter(keep(bound))
    return rows


def by_estimate(frame: DataFrame, names: tuple[str, ...] = ESTIMATES) -> DataFrame:
    """frame with one row per estimate: estimate (its name) and value."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("estimate"), F.col(n).cast("double").alias("value")) for n in names]))
    rest = [c for c in frame.columns if c not in ESTIMATES]
    return frame.select(*rest, each.alias("e")).select(*rest, "e.*")


def agreement(rows: DataFrame, least: int = 2) -> DataFrame:
    """One row per (series, estimate) of rows(series, estimate, value, upstream_flow): correlations, KGE and its parts, bias, NSE, RMSE, coverage.

    Over pairs that both have; metrics that are not defined (too few pairs, a constant side, a mean near zero) are null.
    """
    keys = ["series", "estimate"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("candidates"))
    pairs = rows.filter("value IS NOT NULL AND upstream_flow IS NOT NULL").select(*keys, "value", "upstream_flow")
    pairs = staged(pairs, "pairs")
    ranked = pairs.join(average_ranks(pairs, keys, "value", "rx"), [*keys, "value"]).join(average_ranks(pairs, keys, "upstream_flow", "ry"), [*keys, "upstream_flow"])
    error = F.col("value") - F.col("upstream_flow")
    n = F.count("*")
    enough = lambda c: F.when(n >= least, c)
    found = ranked.groupBy(*keys).agg(
        n.alias("paired_observations"),
        enough(correlation("value", "upstream_flow")).alias("pearson_correlation"),
        enough(correlation("rx", "ry")).alias("spearman_correlation"),
        enough(ratio(F.stddev_samp("value"), F.stddev_samp("upstream_flow"))).alias("kge_variability_ratio"),
        enough(ratio(F.avg("value"), F.avg("upstream_flow"))).alias("kge_mean_flow_ratio"),
        enough(ratio(F.sum(error), F.sum("upstream_flow")) * 100).alias("percent_bias"),
        enough(1 - ratio(F.sum(error * error), F.var_pop("upstream_flow") * n)).alias("nse"),
        enough(ratio(F.sqrt(F.avg(error * error)), F.abs(F.avg("upstream_flow")))).alias("normalized_rmse"),
    )
    square = lambda c: (F.col(c) - 1) * (F.col(c) - 1)
    kge = 1 - F.sqrt(square("pearson_correlation") + square("kge_variability_ratio") + square("kge_mean_flow_ratio"))
    joined = sizes.join(found, keys, "left").withColumn("paired_observations", F.coalesce("paired_observations", F.lit(0)))
    return joined.withColumns({"coverage": F.col("paired_observations") / F.col("candidates"), "kge_correlation": F.col("pearson_correlation"), "kge": kge}).drop("candidates")


def lagged_correlations(rows: DataFrame, lag_range: int = 48, least: int = 2, step_us: int = HOUR_US) -> DataFrame:
    """(series, estimate, lag_hours, correlation, paired_observations): estimate at t + lag against upstream at t, for every lag in one join."""
    lags = F.explode(F.sequence(F.lit(-lag_range), F.lit(lag_range)))
    keys = rows.select("series", "estimate").distinct().select("series", "estimate", lags.alias("lag_hours"))
    up = rows.filter("upstream_flow IS NOT NULL").select("series", "estimate", F.col("us").alias("at"), "upstream_flow", lags.alias("lag_hours"))
    moved = up.withColumn("us", F.col("at") + F.col("lag_hours") * F.lit(step_us))
    pairs = moved.join(rows.filter("value IS NOT NULL").select("series", "estimate", "us", "value"), ["series", "estimate", "us"])
    found = pairs.groupBy("series", "estimate", "lag_hours").agg(correlation("value", "upstream_flow", least).alias("correlation"), F.count("*").alias("paired_observations"))
    return keys.join(found, ["series", "estimate", "lag_hours"], "left").withColumn("paired_observations", F.coalesce("paired_observations", F.lit(0)))


def best_lags(curve: DataFrame) -> DataFrame:
    """One row per (series, estimate) of lagged_correlations: zero-lag and largest correlation and its lag, the nearest to zero, then the smallest, of equal ones."""
    order = F.struct(F.col("correlation"), -F.abs("lag_hours"), -F.col("lag_hours"))
    known = F.col("correlation").isNotNull()
    best = F.max_by(F.when(known, F.struct("lag_hours", "correlation", "paired_observations")), F.when(known, order))
    zero = F.max(F.when(F.col("lag_hours") == 0, F.col("correlation")))
    found = curve.groupBy("series", "estimate").agg(zero.alias("zero_lag_pearson_correlation"), best.alias("b"))
    return found.select(
        "series",
        "estimate",
        "zero_lag_pearson_correlation",
        F.col("b.correlation").alias("max_correlation"),
        F.col("b.lag_hours").alias("best_lag_hours"),
        F.coalesce("b.paired_observations", F.lit(0)).alias("paired_observations_at_best_lag"),
        (F.col("b.correlation") - F.col("zero_lag_pearson_correlation")).alias("improvement_over_zero_lag"),
    )


def frozen_lags(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """best_lags of the evaluation curve, at the lag that was best in training where there is one; lag_selection tells which."""
    chosen = best_lags(training).select("series", "estimate", F.col("best_lag_hours").alias("lag_hours")).filter("lag_hours IS NOT NULL")
    own = best_lags(evaluation)
    at = evaluation.join(chosen, ["series", "estimate", "lag_hours"]).select("series", "estimate", "lag_hours", "correlation", F.col("paired_observations").alias("n"))
    both = own.join(at, ["series", "estimate"], "left")
    frozen = F.col("lag_hours").isNotNull()
    pick = lambda a, b: F.when(frozen, a).otherwise(F.col(b)).alias(b)
    return both.select(
        "series",
        "estimate",
        "zero_lag_pearson_correlation",
        pick(F.col("correlation"), "max_correlation"),
        pick(F.col("lag_hours"), "best_lag_hours"),
        pick(F.col("n"), "paired_observations_at_best_lag"),
        pick(F.col("correlation") - F.col("zero_lag_pearson_correlation"), "improvement_over_zero_lag"),
        F.when(frozen, "training (frozen for evaluation)").otherwise("evaluation").alias("lag_selection"),
    )


def closure(rows: DataFrame, factor: float = US.flow_to_volume_per_second, span: int = SPAN_US) -> DataFrame:
    """One row per (series, estimate) of rows(series, us, estimate, value, storage, outflow): predicted less observed storage change, by the rates at each interval's start."""
    keyed = rows.withColumn("series_key", F.to_json(F.struct("series", "estimate")))
    timed = with_previous(keyed, "series_key", ["value", "storage", "outflow"], "before", span)
    dt = elapsed_seconds(F.col("us"), F.col("before.us"))
    error = (F.col("before.value") - F.col("before.outflow")) * dt * factor - (F.col("storage") - F.col("before.storage"))
    each = timed.withColumns({"error": F.when(dt > 0, error), "flow_error": F.when(dt > 0, error / (dt * factor))})
    stats = lambda c, tail: [F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rmse{tail}"), F.avg(F.abs(c)).alias(f"mae{tail}"), F.avg(c).alias(f"bias{tail}")]
    n = F.count("error")
    return each.groupBy("series", "estimate").agg(n.alias("paired_observations"), ratio(n, F.count("*") - 1).alias("coverage"), *stats("error", ""), *stats("flow_error", "_cfs"))


def behavior(rows: DataFrame, span: int = SPAN_US) -> DataFrame:
    """One row per (series, estimate): finite values, how often and how far below zero, and mean change between neighbouring rows that both have a value."""
    keyed = rows.withColumn("series_key", F.to_json(F.struct("series", "estimate")))
    timed = with_previous(keyed, "series_key", ["value"], "before", span)
    negative = F.col("value") < 0
    return timed.groupBy("series", "estimate").agg(
        F.count("value").alias("finite_observations"),
        (F.avg(negative.cast("int")) * 100).alias("negative_hour_frequency_percent"),
        F.avg(F.when(negative, -F.col("value"))).alias("mean_negative_inflow_cfs"),
        F.avg(F.abs(F.col("value") - F.col("before.value"))).alias("mean_absolute_hourly_change_cfs"),
    )


def validation_tables(comparison: DataFrame, settings: ValidationSettings | None = None) -> dict[str, DataFrame]:
    """The frame and the four tables over it: agreement, lags (chosen in training, if there is any), closure, behavior."""
    s = settings or ValidationSettings()
    frame = validation_frame(comparison, s)
    rows = by_estimate(between(frame, s.evaluated))
    curve = lagged_correlations(rows, s.lag_range, s.least_pairs, s.frequency_us)
    if s.training == (None, None):
        lags = best_lags(curve).withColumn("lag_selection", F.lit("evaluation"))
    else:
        lags = frozen_lags(lagged_correlations(by_estimate(between(frame, s.training)), s.lag_range, s.least_pairs, s.frequency_us), curve)
    return {"validation_frame": frame, "agreement": agreement(rows, s.least_pairs), "lag_curve": curve, "lags": lags, "closure": closure(rows, s.factor), "behavior": behavior(rows)}


