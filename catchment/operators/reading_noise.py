"""The variance of storage readings, from how neighbouring changes cancel; and the check against an upstream gauge's shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, correlation, with_previous
from .prepare import in_windows
from .validation import HOUR_US, regular

WEEK_US = 7 * 86_400_000_000
LEAST_PAIRS, LEAST_IN_WEEK, DISAGREEMENT = 100, 20, 4.0
POOLED = "all"


def reading_noise(rows: DataFrame, windows: DataFrame | None = None, span: int = SPAN_US) -> DataFrame:
    """(series, window, start_us, end_us, r_storage, reading_sd, pairs, blocks, unchanged_share), a row per window and one named all.

    A pair is two changes between three neighbouring, evenly spaced rows with storage, all in the window.
    Reading noise makes such changes cancel: r_storage is the median over weeks (counted from the series' first row; at
    least 20 pairs) of minus their covariance about one common mean, zero if that is negative, null
    under 100 pairs. All windows and weeks are one aggregate over the rows. Without windows, all has every row; else their union.
    """
    one = with_previous(rows.select("series", "us", "storage"), "series", ["storage"], "a", span)
    two = with_previous(one, "series", ["a"], "b", span)
    even = (F.col("us") - F.col("a.us")) == (F.col("a.us") - F.col("b.a.us"))
    triple = even & F.col("storage").isNotNull() & F.col("a.storage").isNotNull() & F.col("b.a.storage").isNotNull()
    first = rows.groupBy("series").agg(F.min("us").alias("origin"), F.max("us").alias("last"))
    later, earlier = F.col("storage") - F.col("a.storage"), F.col("a.storage") - F.col("b.a.storage")
    pairs = two.filter(triple).select("series", "us", F.col("b.a.us").alias("from_us"), later.alias("later"), earlier.alias("earlier")).join(first.select("series", "origin"), "series")
    pairs = pairs.withColumn("week", F.floor((F.col("us") - F.col("origin")) / F.lit(WEEK_US)).cast("long"))
    if windows is None:
        named = pairs.withColumn("window", F.lit(POOLED))
        keys = first.select("series", F.lit(POOLED).alias("window"), F.col("origin").alias("start_us"), F.col("last").alias("end_us"))
    else:
        w = windows.select("series", F.col("name").alias("window"), "start_us", "end_us")
        bad = w.filter(F.col("window") == POOLED).limit(1)
        if not bad.isEmpty():
            raise ValueError(f"the window name {POOLED} is reserved")
        inside = in_windows(pairs, windows, bounds=True).filter("from_us >= start_us").withColumnRenamed("name", "window")
        union = _in_union(pairs, windows)
        named = inside.drop("start_us", "end_us").unionByName(union.withColumn("window", F.lit(POOLED)))
        ends = in_windows(rows.select("series", "us"), windows).groupBy("series").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        keys = w.unionByName(first.select("series").join(ends, "series", "left").select("series", F.lit(POOLED).alias("window"), "start_us", "end_us"))
    product = F.avg(F.col("later") * F.col("earlier"))
    mean = (F.avg("later") + F.avg("earlier")) / 2
    weeks = named.groupBy("series", "window", "week").agg(
        F.count("*").alias("n"),
        (-(product - mean * (F.avg("later") + F.avg("earlier")) + mean * mean)).alias("estimate"),
        F.count_if(F.col("later") == 0).alias("still"),
    )
    big = F.when(F.col("n") >= LEAST_IN_WEEK, F.col("estimate"))
    found = weeks.groupBy("series", "window").agg(F.sum("n").alias("pairs"), F.count(big).alias("blocks"), F.median(big).alias("middle"), (F.sum("still") / F.sum("n")).alias("share"))
    enough = (F.col("pairs") >= LEAST_PAIRS) & (F.col("blocks") > 0)
    r = F.when(enough, F.greatest("middle", F.lit(0.0)))
    return keys.join(found, ["series", "window"], "left").select(
        "series",
        "window",
        "start_us",
        "end_us",
        r.alias("r_storage"),
        F.sqrt(r).alias("reading_sd"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.when(F.col("pairs") >= LEAST_PAIRS, F.col("blocks")).otherwise(0).alias("blocks"),
        F.when(enough, F.col("share")).alias("unchanged_share"),
    )


def _in_union(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs all of whose rows lie in some window; the middle row lies half-way as the spacing is even."""
    middle = F.col("from_us") + (F.col("us") - F.col("from_us")) / 2
    out = pairs.withColumn("mid_us", middle.cast("long")).withColumn("pair", F.struct("series", "us"))
    ends = in_windows(out.select("pair", "series", F.explode(F.array("from_us", "mid_us", "us")).alias("us")), windows)
    whole = ends.groupBy("pair").agg(F.countDistinct("us").alias("n")).filter("n = 3")
    return out.join(whole.select("pair"), "pair", "left_semi").drop("pair", "mid_us")


def reading_noise_warnings(table: DataFrame) -> DataFrame:
    """(series, warning): no estimate, no signal, windows without any, or windows that differ by more than a factor of four."""
    whole = table.filter(F.col("window") == POOLED)
    none = whole.filter("r_storage IS NULL").select("series", F.lit("no estimate: too few evenly spaced pairs").alias("warning"))
    flat = whole.filter("r_storage = 0").select("series", F.lit("no estimate: changes are not negatively correlated").alias("warning"))
    parts = table.filter(F.col("window") != POOLED)
    zero = parts.filter("r_storage = 0").select("series", F.concat("window", F.lit(" gave no estimate")).alias("warning"))
    spread = parts.filter("r_storage > 0").groupBy("series").agg(F.min_by("window", "r_storage").alias("low"), F.max_by("window", "r_storage").alias("high"), (F.max("r_storage") / F.min("r_storage")).alias("times"), F.count("*").alias("n"))
    differ = spread.filter((F.col("n") > 1) & (F.col("times") > DISAGREEMENT)).select("series", F.concat(F.lit("reading noise differs between "), "low", F.lit(" and "), "high").alias("warning"))
    return none.unionByName(flat).unionByName(zero).unionByName(differ)


@dataclass(frozen=True)
class ProxySettings:
    frequency_us: int = HOUR_US
    max_lag_us: int = 12 * HOUR_US
    least_points: int = 12
    least_shape: float = 0.2
    least_change: float = 0.1


def proxy_check(rows: DataFrame, settings: ProxySettings | None = None) -> DataFrame:
    """One row per series of rows(series, us, estimate, proxy): the shift of the proxy that fits the estimate best, by shape only.

    Both are averaged on a regular clock; every whole shift within max_lag_us scores 0.6 of the
    correlation of levels plus 0.4 of that of changes (between neighbouring pairs, gaps closed); the earliest
    of equal shifts wins. A positive lag moves the proxy later.
    """
    s = settings or ProxySettings()
    clock = regular(rows, ["estimate", "proxy"], s.frequency_us)
    steps = s.max_lag_us // s.frequency_us
    shifted = clock.select("series", "us", "estimate", F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("offset"))
    at = clock.select("series", F.col("us").alias("at"), "proxy")
    pairs = shifted.filter("estimate IS NOT NULL").withColumn("at", F.col("us") + F.col("offset") * F.lit(s.frequency_us)).join(at.filter("proxy IS NOT NULL"), ["series", "at"])
    order = Window.partitionBy("series", "offset").orderBy("us")
    changes = pairs.withColumns({"de": F.col("estimate") - F.lag("estimate").over(order), "dp": F.col("proxy") - F.lag("proxy").over(order)})
    found = changes.groupBy("series", "offset").agg(F.count("*").alias("n"), correlation("estimate", "proxy", 3).alias("shape"), correlation("de", "dp", 3).alias("change"))
    usable = found.filter((F.col("n") >= s.least_points) & F.col("shape").isNotNull()).withColumn("change", F.coalesce("change", F.lit(0.0)))
    best = usable.groupBy("series").agg(F.max_by(F.struct("offset", "shape", "change"), F.struct(0.6 * F.col("shape") + 0.4 * F.col("change"), -F.col("offset"))).alias("b"))
    aligned = clock.groupBy("series").agg(F.count_if(F.col("estimate").isNotNull() & F.col("proxy").isNotNull()).alias("proxy_aligned_count"))
    ok = (F.col("b.shape") >= s.least_shape) & (F.col("b.change") >= s.least_change)
    few = F.col("proxy_aligned_count") < s.least_points
    return aligned.join(best, "series", "left").select(
        "series",
        "proxy_aligned_count",
        F.when(~few, -F.col("b.offset") * F.lit(s.frequency_us / 1e6)).alias("proxy_best_lag_seconds"),
        F.when(~few, F.col("b.shape")).alias("proxy_shape_correlation"),
        F.when(~few, F.col("b.change")).alias("proxy_change_correlation"),
        (~few & F.coalesce(ok, F.lit(False))).alias("proxy_check_passed"),
    )
