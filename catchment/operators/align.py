"""Sources brought to one clock: the latest reading within a tolerance, the outflow rule, trimming and the audit of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, span_of, with_previous
from ..sources.gauges import GAP_US

# How a series' outflow was found.
JOINED = "outlet discharge + finite spillway flow; unknown spillway is missing"
ALONE = "downstream discharge only; spillway unavailable in requested data"


def asof(clock: DataFrame, readings: DataFrame, tolerance_us: int) -> DataFrame:
    """clock(series, us, ...) with one column per source of readings(series, source, us, value): its latest value.

    The latest reading at or before the clock's time counts if it is no older than tolerance_us, the limit included.
    A reading whose value is missing still is the latest, so the result is then missing. All
    sources are matched in one pass: clock and readings are merged in time order, and each clock row takes the last
    reading of each source before it. Readings are copied to the spans that their tolerance reaches,
    so a long series is matched in many tasks. Source names are the values found (few); readings must be one per source and time.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance must be positive")
    names = sorted(r.source for r in readings.select("source").distinct().collect())
    return _asof(clock, readings, names, tolerance_us, SPAN_US)


def _asof(clock: DataFrame, readings: DataFrame, names: list[str], tolerance_us: int, span: int) -> DataFrame:
    last = F.floor((F.col("us") + tolerance_us) / F.lit(span)).cast("long")
    spread = readings.select("series", "us", "source", "value", F.explode(F.sequence(span_of("us", span), last)).alias("__span")).withColumn("__clock", F.lit(0))
    own = clock.select("series", "us", span_of("us", span).alias("__span"), F.lit(1).alias("__clock"))
    both = own.withColumns({"source": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}).unionByName(spread)
    order = Window.partitionBy("series", "__span").orderBy("us", "__clock").rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.last(F.when(F.col("source") == n, F.struct("us", "value")), True).over(order) for n in names}
    matched = both.withColumns({f"__{n}": c for n, c in found.items()}).filter("__clock = 1")
    values = [F.when(F.col("us") - F.col(f"__{n}.us") <= tolerance_us, F.col(f"__{n}.value")).alias(n) for n in names]
    return clock.join(matched.select("series", "us", *values).distinct(), ["series", "us"], "left")


def combined_outflow(aligned: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """aligned(series, us, storage, outlet, spillway, ...) within [start_us, end_us] with outflow and how it was found.

    If a series has a spillway reading of zero or more in the window, its outflow is outlet plus spillway where the latter is known and
    not negative, else missing, never the outlet alone; without any it is the outlet.
    """
    usable = F.col("spillway").isNotNull() & (F.col("spillway") >= 0)
    rows = aligned.filter(F.col("us").between(start_us, end_us)).withColumn("spillway_available", usable)
    any_ = rows.groupBy("series").agg(F.max("spillway_available").alias("joined"))
    known = rows.join(any_, "series")
    used = F.col("joined") & F.col("spillway_available")
    outflow = F.when(~F.col("joined"), F.col("outlet")).when(F.col("spillway_available"), F.col("outlet") + F.col("spillway"))
    return known.withColumns({"outflow": outflow, "spillway_used": used, "spillway_unknown": ~F.col("spillway_available"), "outflow_definition": F.when(F.col("joined"), JOINED).otherwise(ALONE)}).drop("joined")


def from_first_joint(rows: DataFrame) -> DataFrame:
    """rows from each series' first one with both storage and outflow on; a series without any is dropped."""
    first = rows.filter("storage IS NOT NULL AND outflow IS NOT NULL").groupBy("series").agg(F.min("us").alias("__first"))
    return rows.join(first, "series").filter("us >= __first").drop("__first")


def window_audit(rows: DataFrame, span: int = SPAN_US, requested: tuple[int, int, int] | None = None) -> DataFrame:
    """One row per series of combined_outflow's result: extent, missing counts, spillway counts, median interval and gaps.

    With requested (start_us, end_us, tolerance_us), these are columns too.
    """
    timed = with_previous(rows, "series", ["us"], "before", span).withColumn("gap", F.col("us") - F.col("before.us"))
    missing = lambda c: F.count_if(F.col(c).isNull()).alias(f"{c}_missing")
    asked = [F.lit(x).cast("long").alias(n) for n, x in zip(("requested_start_us", "requested_end_us", "asof_tolerance_us"), requested or (), strict=False)]
    found = timed.groupBy("series").agg(
        F.min("us").alias("actual_start_us"),
        F.max("us").alias("actual_end_us"),
        F.count("*").alias("rows"),
        missing("storage"),
        missing("outflow"),
        missing("upstream"),
        F.count_if("spillway_unknown").alias("spillway_unknown"),
        F.count_if(F.col("spillway") < 0).alias("spillway_invalid"),
        F.count_if("spillway_used").alias("spillway_used"),
        (F.median("gap") / 60e6).alias("median_interval_min"),
        F.count_if(F.col("gap") > GAP_US).alias("intervals_over_20min"),
        F.max("outflow_definition").alias("outflow_definition"),
    )
    return found.select("series", *asked, *[c for c in found.columns if c != "series"])


def outer_aligned(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("estimate", "upstream")) -> DataFrame:
    """(series, us, a, b): the values of two frames (series, us, value) at all times of either."""
    a = left.select("series", "us", F.col("value").alias(names[0]))
    b = right.select("series", "us", F.col("value").alias(names[1]))
    return a.join(b, ["series", "us"], "full_outer")


def shared_times(left: DataFrame, right: DataFrame) -> DataFrame:
    """(series, us, value, other): left(series, us, value) with right's value at exactly the same time, else null."""
    return left.select("series", "us", "value").join(right.select("series", "us", F.col("value").alias("other")), ["series", "us"], "left")


def unmatched_times(left: DataFrame, right: DataFrame) -> DataFrame:
    """(series, us, side) for times that only one of two frames has; none if the frames share an index."""
    a, b = left.select("series", "us").distinct().withColumn("l", F.lit(True)), right.select("series", "us").distinct().withColumn("r", F.lit(True))
    both = a.join(b, ["series", "us"], "full_outer").filter("l IS NULL OR r IS NULL")
    return both.select("series", "us", F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))
