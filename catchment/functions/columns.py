"""Expressions that the operators share: exact time, missing values, previous and next rows without a task per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A series is worked on in spans of so many microseconds, one group each; a month at a reading a minute is 43 000 rows.
SPAN_US = 30 * 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, or of a timestamp_ntz read as UTC whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    second = F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
    return day + second + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def finite(value: str | Column) -> Column:
    """The value, with NaN and infinities as null: null is the only missing value inside the library."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def span_of(us: str = "us", span: int = SPAN_US) -> Column:
    return F.floor(F.col(us) / F.lit(span)).cast("long")


def _neighbour(df: DataFrame, key: str, columns: list[str], name: str, step: int, span: int) -> DataFrame:
    inside = Window.partitionBy(key, "__span").orderBy("us")
    value = F.struct("us", *[c for c in columns if c != "us"])
    spans = df.withColumn("__span", span_of("us", span))
    edge = (F.max if step > 0 else F.min)(value)
    edges = spans.groupBy(key, "__span").agg(edge.alias("edge"))
    across = edges.select(key, "__span", F.lag("edge", step).over(Window.partitionBy(key).orderBy("__span")).alias("__edge"))
    joined = spans.withColumn("__own", F.lag(value, step).over(inside)).join(across, [key, "__span"], "left")
    return joined.withColumn(name, F.coalesce("__own", "__edge")).drop("__own", "__edge", "__span")


def with_previous(df: DataFrame, key: str, columns: list[str], name: str = "previous", span: int = SPAN_US) -> DataFrame:
    """df with the struct `name` of us and columns of the row before in its series (null for the first).

    A long series is not sorted in one task: rows are windowed within spans of time, and a span's last
    row, found by an aggregate, is carried to the next span that has rows. us must not repeat within a series.
    """
    return _neighbour(df, key, columns, name, 1, span)


def with_next(df: DataFrame, key: str, columns: list[str], name: str = "next", span: int = SPAN_US) -> DataFrame:
    """df with the struct `name` of us and columns of the row behind in its series (null for the last)."""
    return _neighbour(df, key, columns, name, -1, span)


def correlation(x: str, y: str, least: int = 2) -> Column:
    """Pearson correlation of pairs without nulls; null for fewer than least pairs or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    flat = F.least(F.stddev_pop(a), F.stddev_pop(b)) <= 2.220446049250313e-16
    # corr() itself divides by zero for a constant side under ANSI rules.
    return F.when((F.count(a) >= least) & ~flat, F.covar_pop(a, b) / spread)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null if bottom is null or zero to rounding."""
    return F.when(F.abs(bottom) > 2.220446049250313e-16, top / bottom)
