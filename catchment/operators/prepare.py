"""From readings to filter steps: cleaning, order, the two rows that start a series, elapsed time, release times, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, finite, span_of, with_previous
from .ranks import equal_part, ranked

#: Buckets of windows are 2^41 microseconds long at most, some 25 days.
MOST_BITS = 41
OBSERVATION = "series string, us long, storage double, outflow double"


def observations(df: DataFrame, series: str | Column, us: str | Column, storage: str | Column, outflow: str | Column) -> DataFrame:
    """(series, us, storage, outflow): the columns that the estimators read, NaN and infinities as null."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(series).alias("series"), as_column(us).cast("long").alias("us"), finite(as_column(storage).cast("double")).alias("storage"), finite(as_column(outflow).cast("double")).alias("outflow"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per keys: the last by order. An aggregate, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("row"))
    return last.select(*keys, "row.*").select(*df.columns)


def order_faults(obs: DataFrame) -> DataFrame:
    """(series, us, fault) for rows that break the contract: a missing time, or two rows of one series and time."""
    missing = obs.filter("us IS NULL OR series IS NULL").select("series", "us", F.lit("missing").alias("fault"))
    repeated = obs.filter("us IS NOT NULL AND series IS NOT NULL").groupBy("series", "us").agg(F.count("*").alias("n")).filter("n > 1")
    return missing.unionByName(repeated.select("series", "us", F.lit("repeated").alias("fault")))


def checked_order(obs: DataFrame) -> DataFrame:
    """obs, if no row breaks the time contract (see order_faults); otherwise an error that names one."""
    bad = order_faults(obs).orderBy("series", "us").head(1)
    if bad:
        raise ValueError(f"every reading needs a series and a time of its own: {bad[0].fault} in series {bad[0].series} at {bad[0].us}")
    return obs


def frame_faults(obs: DataFrame) -> DataFrame:
    """(series, us, fault): those of order_faults, and series with fewer than two storage readings (us null)."""
    few = obs.filter("series IS NOT NULL").groupBy("series").agg(F.count("storage").alias("n")).filter("n < 2")
    return order_faults(obs).unionByName(few.select("series", F.lit(None).cast("long").alias("us"), F.lit("too few storage readings").alias("fault")))


def checked_frame(obs: DataFrame) -> DataFrame:
    """obs, if it has rows and no fault; otherwise an error."""
    if obs.isEmpty():
        raise ValueError("the window has no readings")
    bad = frame_faults(obs).orderBy("series", "us").head(1)
    if bad:
        raise ValueError(f"{bad[0].fault} in series {bad[0].series} at {bad[0].us}")
    return obs


def starts(obs: DataFrame) -> DataFrame:
    """(series, first_us, first_storage, first_outflow, second_us, scorable): the two rows that start the filter.

    The first two rows with a storage reading; second_us is null where there is no second, and
    first_outflow null where the first lacks its outflow (such a series can't start). One row per series, by two
    combined aggregates.
    """
    seen = obs.filter("storage IS NOT NULL")
    first = seen.groupBy("series").agg(F.min(F.struct("us", "storage", "outflow")).alias("f"))
    later = seen.join(first, "series").filter("us > f.us").groupBy("series").agg(F.min("us").alias("second_us"))
    return first.join(later, "series", "left").select("series", F.col("f.us").alias("first_us"), F.col("f.storage").alias("first_storage"), F.col("f.outflow").alias("first_outflow"), "second_us")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds and the rest of a difference in microseconds, added up."""
    gap = later - earlier
    return F.floor(gap / 1_000_000).cast("double") + F.pmod(gap, F.lit(1_000_000)) / F.lit(1e6)


def steps(obs: DataFrame, strict: bool = True, span: int = SPAN_US) -> DataFrame:
    """Filter steps: (series, us, storage, outflow, dt, first_us, second_us, first_storage, first_outflow).

    Of each series the first row with storage, then the second such row and all after it; rows in
    between are left out. dt is the time since the step before in seconds (null for the first). Series without two
    storage readings have no steps. A series whose first storage reading lacks its outflow is an error
    if strict, else it has no steps.
    """
    known = starts(obs).filter("second_us IS NOT NULL")
    if strict:
        bad = F.raise_error(F.concat(F.lit("the first storage reading needs an outflow, series "), F.col("series").cast("string"))).cast("double")
        known = known.withColumn("first_outflow", F.coalesce("first_outflow", bad))
    else:
        known = known.filter("first_outflow IS NOT NULL")
    kept = obs.join(known, "series").filter("us = first_us OR us >= second_us")
    timed = with_previous(kept, "series", ["storage"], "before", span)
    return timed.withColumn("dt", elapsed_seconds(F.col("us"), F.col("before.us"))).drop("before")


def release_times(rows: DataFrame, lag_us: int, span: int = SPAN_US) -> DataFrame:
    """rows(series, us, ...) with release_us: the first time in the series at least lag_us later; null if none.

    Within spans of time the frame is a range of microseconds. Each span also gets the first row behind every row's lag:
    rows of later spans are copied back to the spans whose lag reaches them, and the first
    row after a span's last reach is carried to it.
    """
    own = rows.withColumn("__span", span_of("us", span))
    ends = own.groupBy("series", "__span").agg(F.max("us").alias("last"))
    back = own.select("series", F.explode(F.sequence(F.floor((F.col("us") - lag_us) / F.lit(span)).cast("long"), F.col("__span"))).alias("__span"), "us", (F.col("__span")).alias("__from"))
    copies = back.filter("__span < __from").join(ends, ["series", "__span"]).filter(F.col("us") <= F.col("last") + lag_us).select("series", "__span", "us", F.lit(False).alias("__own"))
    heads = own.groupBy("series", "__span").agg(F.min("us").alias("head"))
    nexts = _first_after(own, ends, heads, lag_us, span).select("series", "__span", "us", F.lit(False).alias("__own"))
    clock = own.select("series", "__span", "us", F.lit(True).alias("__own")).unionByName(copies).unionByName(nexts)
    frame = Window.partitionBy("series", "__span").orderBy("us").rangeBetween(lag_us, Window.unboundedFollowing)
    found = clock.withColumn("release_us", F.min("us").over(frame)).filter("__own").select("series", "us", "release_us")
    return rows.join(found, ["series", "us"], "left")


def _first_after(own: DataFrame, ends: DataFrame, heads: DataFrame, lag_us: int, span: int) -> DataFrame:
    """For each span the series' first time at or after its last row plus the lag, if there is one."""
    reach = ends.select("series", "__span", (F.col("last") + lag_us).alias("reach")).withColumn("in_span", F.floor(F.col("reach") / F.lit(span)).cast("long"))
    same = own.select("series", F.col("__span").alias("in_span"), "us").join(reach, ["series", "in_span"]).filter("us >= reach").groupBy("series", "__span").agg(F.min("us").alias("us"))
    marks = heads.select("series", F.col("__span").alias("at"), "head", F.lit(None).cast("long").alias("__span")).unionByName(reach.select("series", F.col("in_span").alias("at"), F.lit(None).cast("long").alias("head"), "__span"))
    behind = Window.partitionBy("series").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    later = marks.withColumn("us", F.min("head").over(behind)).filter("__span IS NOT NULL AND us IS NOT NULL").select("series", "__span", "us")
    return same.unionByName(later).groupBy("series", "__span").agg(F.min("us").alias("us"))


def active_counts(rows: DataFrame, lag_us: int, span: int = SPAN_US) -> DataFrame:
    """rows with active: how many rows of the series lie in (us - lag_us, us]; a smoother holds these and itself.

    A window of more than its limit would overflow. Rows are copied to later spans as far as the lag reaches.
    """
    last = F.floor((F.col("us") + lag_us - 1) / F.lit(span)).cast("long")
    spread = rows.select("series", "us", span_of("us", span).alias("__own")).select("series", "us", "__own", F.explode(F.sequence(F.col("__own"), last)).alias("__span"))
    frame = Window.partitionBy("series", "__span").orderBy("us").rangeBetween(-(lag_us - 1), 0)
    counted = spread.withColumn("active", F.count("*").over(frame)).filter("__own = __span").select("series", "us", "active")
    return rows.join(counted, ["series", "us"], "left")


def split_windows(times: DataFrame, count: int) -> DataFrame:
    """(series, name, start_us, end_us, n): each series' distinct times in `count` windows of equal numbers, earlier ones larger by one.

    A window ends where the next starts; the last ends a microsecond after its last time. Series of fewer times have fewer windows. Places are
    found by ranges (see ranks.ranked), so a series of any length is dealt over all tasks.
    """
    placed = ranked(times.select("series", "us").distinct(), ["series"], ["us"], "place", "many").withColumn("part", equal_part("place", "many", count))
    sizes = placed.groupBy("series", "part").agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
    after = F.lead("start_us").over(Window.partitionBy("series").orderBy("part"))
    return sizes.select("series", F.concat(F.lit("window-"), F.col("part")).alias("name"), "start_us", F.coalesce(after, F.col("last_us") + 1).alias("end_us"), "n")


def window_faults(windows: DataFrame) -> DataFrame:
    """(series, name, fault) for windows whose name repeats, that are empty, or that start before the one ahead of them ends."""
    order = Window.partitionBy("series").orderBy("start_us", "end_us")
    seen = windows.withColumn("before", F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("same", F.count("*").over(Window.partitionBy("series", "name")))
    fault = F.when(F.col("same") > 1, "repeated").when(F.col("start_us") >= F.col("end_us"), "empty").when(F.col("before") > F.col("start_us"), "overlap")
    return seen.select("series", "name", fault.alias("fault")).filter("fault IS NOT NULL")


def in_windows(rows: DataFrame, windows: DataFrame, bounds: bool = False, most: int = MOST_BITS) -> DataFrame:
    """rows with the name of their series' window [start_us, end_us) (and with bounds these two), once for each window that they lie in; rows outside all are dropped.

    A window lies in buckets of time about as long as itself (a power of two, 2^most microseconds at most), so in two of them or, if it is longer than that, in as many
    as it reaches over the rows' times; rows are looked up in the bucket that holds them, once for each bucket length that occurs. So the work grows with the rows and the
    windows, not with their product, and a series is as many keys as it has buckets.
    """
    w = windows.select("series", "name", "start_us", "end_us").filter("start_us < end_us")
    w = w.withColumn("__bits", F.least(F.ceil(F.log2(F.col("end_us").cast("double") - F.col("start_us").cast("double"))), F.lit(most)).cast("int"))
    ends = rows.agg(F.min("us"), F.max("us")).first()
    lengths = sorted(r[0] for r in w.select("__bits").distinct().collect())
    if ends[0] is None or not lengths:
        return rows.join(w.limit(0).select("series", "name", "start_us", "end_us"), "series").select(*rows.columns, "name", *["start_us", "end_us"] * bounds)
    first, last = f"greatest(start_us, {ends[0]}L)", f"least(end_us - 1, {ends[1]}L)"
    held = w.filter(f"{first} <= {last}").withColumn("__bucket", F.explode(F.expr(f"sequence(shiftright({first}, __bits), shiftright({last}, __bits))")))
    looked = rows.withColumn("__bits", F.explode(F.array(*[F.lit(b) for b in lengths]))).withColumn("__bucket", F.expr("shiftright(us, __bits)"))
    return looked.join(held, ["series", "__bits", "__bucket"]).filter("us >= start_us AND us < end_us").select(*rows.columns, "name", *["start_us", "end_us"] * bounds)


def window_capacity(step_rows: DataFrame, windows: DataFrame, warmup_us: int, least: int) -> DataFrame:
    """(series, name, scorable, enough): storage readings of each window behind both starting rows and the warm-up."""
    scored = step_rows.withColumn("scored", (F.col("us") > F.col("second_us")) & (F.col("us") >= F.col("second_us") + warmup_us) & F.col("storage").isNotNull())
    counted = in_windows(scored, windows).groupBy("series", "name").agg(F.count_if("scored").alias("scorable"))
    joined = windows.select("series", "name").join(counted, ["series", "name"], "left").withColumn("scorable", F.coalesce("scorable", F.lit(0)))
    return joined.withColumn("enough", F.col("scorable") >= least)
