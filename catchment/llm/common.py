"""What the text operators share: batches of texts and joins on uneven groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_dir, shared_dir, staged

__all__ = ["documents", "join_groups", "new_dir", "perhaps", "shared_dir", "staged", "text_slices", "whole_text", "without"]

#: A group of more than one row in so many is dealt with by a broadcast; so at most this many groups are broadcast.
HOT_SHARE = 2000

#: 64-bit words of the Bloom filters that are broadcast: at most so many rows of 16 bytes.
FILTER_WORDS = 1 << 20

#: Bytes of text that Python works on at a time.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> F.Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts as binary) of at most about limit bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_binary())
        texts = texts.fill_null(b"")
        sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield ids.slice(first, i - first), texts.slice(first, i - first)
                first, total = i, 0
            total += int(size)
        if first < len(sizes):
            yield ids.slice(first), texts.slice(first)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows join groups on key, where groups has one row per key and its number of rows in size.

    Groups of more than total / HOT_SHARE rows are fewer than HOT_SHARE, so they are broadcast and
    their rows never meet in one task; all others go through a shuffle join. how: inner or left.
    Keys must not be null.
    """
    hot = groups.filter(F.col(size) > total / HOT_SHARE)
    cold = groups.filter(F.col(size) <= total / HOT_SHARE)
    return rows.join(F.broadcast(hot), key, "inner").unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    )


def _bits(h: str) -> str:
    """Three bits of one word of a filter, as SQL over a hash column."""
    return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {40 + 6 * i}) & 63 AS int))" for i in range(3))


def perhaps(rows: DataFrame, keys: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """rows with `__maybe`, false only where key isn't in keys(key). No shuffle of rows.

    keys become a Bloom filter of at most `words` rows, whatever their number; so what is broadcast is bounded,
    and with far more keys than words the filter only tells less. A null key is never in keys.
    """
    h = F.xxhash64(key)
    table = keys.select(h.alias("__h")).groupBy(F.expr(f"__h & {words - 1}L").alias("__word")).agg(F.expr(f"bit_or({_bits('__h')})").alias("__mask"))
    own = rows.withColumn("__h", h).withColumn("__word", F.expr(f"__h & {words - 1}L"))
    met = own.join(F.broadcast(table), "__word", "left")
    return met.withColumn("__maybe", F.expr(f"{key} IS NOT NULL AND coalesce(__mask & ({_bits('__h')}) = ({_bits('__h')}), false)")).drop("__h", "__word", "__mask")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in keys(key): a left anti join in which only rows that a filter can't clear are shuffled."""
    tested = perhaps(rows, keys, key)
    return tested.filter("NOT __maybe").unionByName(tested.filter("__maybe").join(keys, key, "left_anti")).select(*rows.columns)
