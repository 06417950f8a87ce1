"""Inflow estimates for every reading: causal and revised, with flags, deviations and intervals."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US
from ..plans.config import SeriesConfig
from ..sources.shared import staged
from .filtering import filtered, smoothed
from .prepare import active_counts, checked_order, steps

NORMAL, PREDICTED, SMOOTHED, NON_SMOOTHED = "NORMAL", "PREDICTED", "SMOOTHED", "NON_SMOOTHED"


def deviation(variance: str) -> Column:
    """The root of a variance; one below zero by more than rounding is an error, by rounding counts as zero."""
    v = F.col(variance)
    low = v < -1e-12 * F.greatest(F.lit(1.0), F.abs(v))
    return F.when(low, F.raise_error(F.lit(f"negative variance {variance}")).cast("double")).otherwise(F.sqrt(F.greatest(v, F.lit(0.0))))


def states(obs: DataFrame, config: SeriesConfig, strict: bool = True, span: int = SPAN_US, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Filtered states of obs(series, us, storage, outflow), or these columns of them; see steps for which rows have one. Written once, as what follows reads them more than once."""
    found = filtered(staged(steps(obs, strict, span), "steps"), config, span)
    return staged(found.select(*columns) if columns else found, "states")


def estimate(obs: DataFrame, config: SeriesConfig, uncertainty: bool = False, provisional: bool = False, strict: bool = True, check_window: bool = True, span: int = SPAN_US) -> DataFrame:
    """obs with estimated_inflow, revised_inflow, their flags and, with uncertainty, their standard deviations.

    estimated_inflow knows the readings up to its row, revised_inflow those up to the first row
    at least the lag later; it is null until then, or smoothed to the last row with
    provisional. A flag is PREDICTED if a reading was missing, else NORMAL. Rows without a step (before the second
    storage reading, or series with less than two) keep nulls. check_window fails if more rows than the
    configured window wait for release. Rows without a time, or two of one series and time, are an error. Null and NaN readings are missing; no rows give no rows.
    """
    step_rows = staged(steps(checked_order(obs), strict, span), "steps")
    if check_window:
        if not active_counts(step_rows.select("series", "us"), config.lag_us, span).filter(F.col("active") > config.max_window).isEmpty():
            raise OverflowError("more rows than max_window wait for release")
    causal = staged(filtered(step_rows, config, span), "states")
    revised = smoothed(causal, config, provisional, span=span)
    flag = F.when(F.col("storage").isNotNull() & F.col("outflow").isNotNull(), NORMAL).otherwise(PREDICTED)
    both = causal.select("series", "us", F.col("m1").alias("estimated_inflow"), flag.alias("flag"), "p11").join(revised.select("series", "us", "sm1", "sp11", "released"), ["series", "us"])
    columns = [
        "estimated_inflow",
        F.col("sm1").alias("revised_inflow"),
        F.col("flag").alias("estimated_inflow_flag"),
        F.when(F.col("released"), F.col("flag")).alias("revised_inflow_flag"),
        F.when(F.col("released"), SMOOTHED).alias("revised_smoothing"),
    ]
    if uncertainty:
        columns += [deviation("p11").alias("estimated_inflow_standard_deviation"), F.when(F.col("sp11").isNotNull(), deviation("sp11")).alias("revised_inflow_standard_deviation")]
    joined = obs.join(both.select("series", "us", *columns), ["series", "us"], "left")
    flags = {"estimated_inflow_smoothing_flag": F.lit(NON_SMOOTHED), "revised_inflow_smoothing_flag": F.coalesce("revised_smoothing", F.lit(NON_SMOOTHED))}
    names = [*obs.columns, "estimated_inflow", "revised_inflow", "estimated_inflow_flag", "revised_inflow_flag", *flags]
    names += ["estimated_inflow_standard_deviation", "revised_inflow_standard_deviation"] if uncertainty else []
    return joined.withColumns(flags).select(*names)


def quantile(level: float) -> float:
    """How many deviations a central interval of the level reaches on either side."""
    if isinstance(level, bool) or not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    return -statistics.NormalDist().inv_cdf((1 - level) / 2)


def with_intervals(result: DataFrame, level: float = 0.95) -> DataFrame:
    """result with {estimated,revised}_inflow_{lower,upper}, replacing any it has. Values and deviations must be missing together."""
    z = quantile(level)
    out = result
    for name in ("estimated_inflow", "revised_inflow"):
        value, sd = F.col(name), F.col(f"{name}_standard_deviation")
        wrong = (value.isNull() != sd.isNull()) | (sd < 0)
        checked = F.when(wrong, F.raise_error(F.lit(f"{name} and its deviation don't match")).cast("double")).otherwise(sd)
        out = out.withColumns({f"{name}_lower": value - z * checked, f"{name}_upper": value + z * checked})
    return out
