"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, staged, whole_text

#: 64-bit words of the Bloom filter; its table has at most so many rows of 16 bytes and is broadcast.
FILTER_WORDS = 1 << 20


def _bits(sha: Column) -> Column:
    """Up to three bits, all in one word of the filter."""
    h = F.xxhash64(sha)
    return F.array_distinct(F.array(*[F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]))


def _word(sha: Column, words: int) -> Column:
    return F.xxhash64(sha).bitwiseAND(F.lit(words - 1))


def _mask() -> Column:
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(__h, {40 + 6 * i}) & 63 as int))" for i in range(3)))


def repeat_filter(hashes: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """First pass, over (sha): (word, mask) with the bits that two or more rows set.

    A hash that occurs twice has all its bits set twice, so no repeat escapes. The counts are
    combined before the shuffle, and the result has at most `words` rows, whatever the input.
    """
    if words & (words - 1):
        raise ValueError("words must be a power of two")
    seen = hashes.select(_word(F.col("sha"), words).alias("word"), F.explode(_bits(F.col("sha"))).alias("bit"))
    twice = seen.groupBy("word", "bit").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def maybe_repeated(rows: DataFrame, repeats: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Second pass: rows with `maybe`, false only where the row's sha occurs once. No shuffle."""
    own = rows.withColumn("__h", F.xxhash64("sha")).withColumn("word", _word(F.col("sha"), words)).withColumn("__mask", _mask())
    met = own.join(F.broadcast(repeats), "word", "left")
    return met.withColumn("maybe", F.coalesce(F.expr("mask & __mask = __mask"), F.lit(False))).drop("word", "mask", "__mask", "__h")


def _sha(text: str) -> Column:
    return F.sha2(whole_text(text).cast("binary"), 256)


def exact_groups(docs: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """For each row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the largest doc_id stays (null ids come last; of rows
    with that same id and text one stays). Null texts equal empty ones. Other columns are not read; texts of any length are hashed whole;
    no rows give no rows.
    The text is read once, for its hash; only rows that the filter can't clear are shuffled.
    """
    hashes = staged(docs.select("doc_id", _sha("text").alias("sha"), F.monotonically_increasing_id().alias("row")), "hashes")
    tested = maybe_repeated(hashes, staged(repeat_filter(hashes, words), "filter"), words)
    again = tested.filter("maybe").drop("maybe")
    groups = staged(_repeated(again), "groups")
    total = hashes.count()
    met = join_groups(again, groups, "sha", "group_size", total, "left")
    straight = tested.filter("not maybe").drop("maybe").withColumns({"keep": F.struct("doc_id", "row", F.lit(1).cast("long").alias("n")), "group_size": F.lit(1).cast("long")})
    return straight.unionByName(met).select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _repeated(again: DataFrame) -> DataFrame:
    """(sha, keep, group_size) of groups of two or more; keep.n tells how many rows share the kept id."""
    each = again.groupBy("sha", "doc_id").agg(F.max("row").alias("row"), F.count("*").alias("n"))
    return each.groupBy("sha").agg(F.max(F.struct("doc_id", "row", "n")).alias("keep"), F.sum("n").alias("group_size")).filter("group_size > 1")


def drop_exact_copies(docs: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """docs with the kept row of each group only, columns unchanged.

    Rows that the filter clears pass straight through, text and all; the others are held against
    the groups. Kept rows of one group (same id and text) are merged into one; only such groups are shuffled for it.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _sha("text").alias("sha"))
    hashes = staged(docs.select("doc_id", _sha("text").alias("sha"), F.monotonically_increasing_id().alias("row")), "hashes")
    repeats = staged(repeat_filter(hashes, words), "filter")
    groups = staged(_repeated(maybe_repeated(hashes, repeats, words).filter("maybe")), "groups")
    tested = maybe_repeated(packed, repeats, words)
    met = join_groups(tested.filter("maybe").drop("maybe"), groups, "sha", "group_size", hashes.count(), "left")
    own = F.col("doc.doc_id").eqNullSafe(F.col("keep.doc_id"))
    out = tested.filter("not maybe").select("doc.*").unionByName(met.filter(F.col("group_size").isNull() | (own & (F.col("keep.n") == 1))).select("doc.*"))
    twins = groups.filter("keep.n > 1")
    if twins.isEmpty():
        return out
    return out.unionByName(tested.filter("maybe").join(twins, "sha").filter(own).dropDuplicates(["sha"]).select("doc.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
