"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding, so that every source's words come out at its target."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import documents, staged, whole_text

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
#: Rows that one task rounds together, and leftovers that the next level of the tree rounds together.
BLOCK = 4096
#: Roundings of a source's last block, of which the one that comes nearest to the target counts.
DRAWS = 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) with target: the sources by code point, null last, share the sum of all sizes by weight.

    A target stops at `most` times the source's size; what is over is shared again by weight among the others until none is
    above. The share of one unit of weight (the level) rises from round to round; a round is one sum over the sources, of which the driver gets three numbers.
    """
    placed = ranked(staged(sizes, "sizes"), [], [F.col("source").isNull(), "source"], "__place", "__sources")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    rows = staged(placed.select("source", "source_size", pick.cast("double").alias("__weight"), (F.lit(most) * F.col("source_size")).alias("__cap")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("__weight") * level > F.col("__cap") if level >= 0 else F.lit(False)
        capped, free = rows.agg(F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__weight")))).first()
        # With no weight left every source is at its cap.
        new = (total - (capped or 0)) / free if free else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("__weight") * level, F.col("__cap").cast("double")).alias("target"))


def pivot(size: np.ndarray, chance: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """(0 or 1 for each item, the one item left over, or -1): dependent rounding in the order given.

    The item in hand and the next one that is undecided trade words: one's chance rises and the other's falls by the same number of
    words, in a direction drawn so that neither's expectation changes, until one of them is 0 or 1. The sum of size times
    chance never changes, so all that is left open is one item's last fraction. Items without words count for nothing and get 0.
    """
    up = np.zeros(len(size), dtype=np.int8)
    toss = draw.random(len(size))
    hand, p = -1, 0.0
    for j, (w, q, u) in enumerate(zip(size.tolist(), chance.tolist(), toss.tolist(), strict=True)):
        if w == 0 or q <= 0:
            continue
        if hand < 0:
            hand, p = j, q
            continue
        v = float(size[hand])
        rise, fall = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
        if u * (rise + fall) < fall:
            # The item in hand gains `rise` words.
            own, other = (1 - p) * v, q * w
            p, q, first, second = p + rise / v, q - rise / w, own <= other, other <= own
            up[hand] |= first
        else:
            own, other = p * v, (1 - q) * w
            p, q, first, second = p - fall / v, q + fall / w, own <= other, other <= own
            up[j] = second
        if first and second:
            hand = -1
        elif first:
            hand, p = j, q
    if hand >= 0:
        chance[hand] = p
    return up, hand


def rounded(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """rows(source, idx, n, size, chance, ...) with extra: 0 or 1, whose sum weighted by size is, in each source, that of chance to within one last document.

    idx is a row's place among the n of its source. Rows idx modulo the number of blocks are rounded together; each block leaves at most one row undecided, and
    the leftovers of a source go to the next level in the same way until one block is left, whose last row is drawn by its chance.
    So a level holds a `block`-th of the rows of the level before. Of a source's last block the best of DRAWS roundings counts. All draws are seeded by source, level and block: a rerun draws the same.
    """
    names = rows.columns
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, extra int, open double"
    todo = rows.withColumn("__place", F.col("idx")).withColumn("__many", F.col("n"))
    most = rows.agg(F.max("n")).first()[0] or 0
    level, done = 0, None
    while most > 0:
        blocks = F.floor((F.col("__many") + (block - 1)) / block)
        keys = [F.col("source"), F.pmod("__place", blocks).alias("__block"), (blocks == 1).alias("__single")]
        out = staged(todo.groupBy(*keys).applyInArrow(_one_block(names, seed, level), schema), f"rounded-{level}")
        closed = out.filter("open IS NULL").select(*names, "extra")
        done = closed if done is None else done.unionByName(closed)
        if most <= block:
            break
        rest = out.filter("open IS NOT NULL").withColumn("chance", F.col("open")).select(*names)
        todo = ranked(rest, ["source"], ["idx"], "__place", "__many")
        most, level = -(-most // block), level + 1
    return done if done is not None else rows.withColumn("extra", F.lit(0))


def _one_block(names: list[str], seed: int, level: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rounds the rows of one block; a row left over gets its chance in `open`, or is drawn if the source has no other block; then the best of several draws counts."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        source, number, single = (k.as_py() for k in key)
        table = table.take(np.argsort(table["idx"].to_numpy(), kind="stable"))
        size, best = table["size"].to_numpy(), None
        for k in range(DRAWS if single else 1):
            draw = np.random.default_rng([seed, zlib.crc32(b"-" if source is None else b"=" + source.encode()), level, number, k])
            chance = table["chance"].to_numpy().copy()
            extra, hand = pivot(size, chance, draw)
            off = 0.0
            if hand >= 0 and single:
                extra[hand] = draw.random() < chance[hand]
                off = abs(size[hand] * (extra[hand] - chance[hand]))
            if best is None or off < best[0]:
                best = off, extra, chance, -1 if single else hand
        _, extra, chance, hand = best
        left = pa.array([float(chance[i]) if i == hand else None for i in range(table.num_rows)], pa.float64())
        return table.select(names).append_column("extra", pa.array(extra, pa.int32())).append_column("open", left)

    return work


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source, ...).

    copies are whole: the source's rate (target / source_size) rounded down, and one more for rows chosen by pivotal dependent rounding weighted by
    size, so that a source's taken words differ from its target by less than one document, mostly a short one, as rows are rounded from
    the longest to the shortest, and as the last block is drawn several times. Each row's copies have the rate as their mean, but for that choice. Null texts have no words; a source without words takes none; null ids and
    repeated rows are rows of their own, and equal ones are interchangeable. Nothing depends on how rows are dealt over tasks.
    """
    sized = staged(docs.select("doc_id", "source", words().alias("size"), F.monotonically_increasing_id().alias("__row")), "sizes")
    targets = staged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    placed = ranked(sized, ["source"], [F.desc("size"), "doc_id", "__row"], "idx", "n").drop("__row")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    own = placed.alias("a").join(targets.withColumnRenamed("source", "__source").alias("t"), F.col("a.source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = staged(own.withColumn("base", F.floor(rate).cast("long")).withColumn("chance", rate - F.floor(rate)), "rates")
    out = rounded(rows, seed)
    copies = F.col("base") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
