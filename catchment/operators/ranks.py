"""Places of rows in the order of their group, dealt over all tasks whatever a group's size, and what follows from them: equal parts, average ranks, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: monotonically_increasing_id counts a partition's rows in the low 33 bits.
ROW_BITS = 33


def ranked(df: DataFrame, by: list[str], order: list[str | Column], pos: str = "pos", size: str = "size") -> DataFrame:
    """df with each row's place (from 0) in its group by the order, and the group's number of rows.

    The rows are dealt into ranges of (by, order), as many as spark.sql.shuffle.partitions, and written; a row's place is its place in
    the range plus the rows of its group in the ranges before, of which there is one count for each range and group in it.
    So a group of any size is ranked by many tasks. Rows that tie in the order get places of their own in no particular order, and
    many of them lie in one range unless the order ends with a column that tells them apart. Null keys are a group like others, and nulls come first
    unless the order says otherwise. df is read twice (once to find the ranges): it should be a table, not a long computation.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else df
    placed = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("__at", ROW_BITS), F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    names = [f"__k{i}" for i in range(len(by))]
    runs = placed.groupBy(part.alias("__part"), *[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.min(at).alias("__low"), F.count("*").alias("__n"))
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range and group: written, so that its size is known and a small table is broadcast.
    counts = staged(runs.withColumns({"__shift": before - F.col("__low"), size: F.sum("__n").over(group)}).drop("__low", "__n"), "counts")
    same = part == F.col("__part")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return placed.join(counts, same).withColumn(pos, at + F.col("__shift")).select(*df.columns, pos, size)


def equal_part(pos: str | Column, size: str | Column, count: int) -> Column:
    """Which of `count` parts (from 1) of equal numbers a place lies in, earlier parts larger by one: ntile of a known place."""
    pos, size = (F.col(c) if isinstance(c, str) else c for c in (pos, size))
    small, large = F.floor(size / F.lit(count)).cast("long"), size % F.lit(count)
    edge = large * (small + 1)
    late = large + F.floor((pos - edge) / F.greatest(small, F.lit(1))).cast("long")
    return (F.when(pos < edge, F.floor(pos / (small + 1)).cast("long")).otherwise(late) + 1).cast("int")


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str = "rank") -> DataFrame:
    """(by..., value, rank) for each distinct value of a group: the mean of the places (from 1) of its rows. Null values have none."""
    counted = staged(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__count")), "values")
    return _with_sums(counted, by, value).select(*by, value, (F.col("__before") + (F.col("__count") + 1) / 2).alias(rank))


def _with_sums(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with their __count, and with the rows of the group that lie before (__before): sums over ranges of the values, and within a range."""
    placed = ranked(counted, by, [value], "__pos", "__size")
    spots = staged(placed.withColumn("__block", F.floor(F.col("__pos") / F.lit(4096)).cast("long")), "spots")
    blocks = spots.groupBy(*by, "__block").agg(F.sum("__count").alias("__sum"))
    ahead = blocks.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*by, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    own = spots.withColumn("__inside", F.coalesce(F.sum("__count").over(inside), F.lit(0)))
    return own.join(ahead, [*by, "__block"]).withColumn("__before", F.col("__ahead") + F.col("__inside"))


def quantiles(df: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(by..., one column a level): quantiles by linear interpolation between the two values that lie about (n - 1) x level. Null values don't count."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*by, value), by, [value], "__pos", "__size")
    picks = []
    for name, level in levels.items():
        spot = (F.col("__size") - 1) * F.lit(float(level))
        share = spot - F.floor(spot)
        weight = F.when(F.col("__pos") == F.floor(spot), 1 - share).when(F.col("__pos") == F.floor(spot) + 1, share)
        picks.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return rows.groupBy(*by).agg(*picks)
