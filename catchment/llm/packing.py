"""Best-fit packing by exact-complement hashing, planned on the histogram of lengths."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged, text_slices
from .vocabulary import default_path, default_pattern, encode_all, same_ids

CAPACITY = 1024
END_ID = 2
#: The pieces of a length are numbered in shares of about this fraction of all pieces.
SHARES = 1024


def pieces(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of docs(doc_id, text, ...).

    A document is its ids and end_id. One longer than capacity is cut into pieces of capacity from
    its end, so only the first piece may be shorter. Null texts count as empty (one piece, the end id). Each row by itself; no shuffle.
    Null and repeated ids are rows like others. A long text's ids are held as one array by one task.
    """
    tokenizer, pattern = tokenizer or default_path("byte_bpe_50k.json"), pattern or default_pattern()
    tail, same = np.array([end_id], dtype="<u4").tobytes(), same_ids(tokenizer, pattern)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, x in zip(ids.to_pylist(), encode_all([t.decode() for t in texts.to_pylist()], tokenizer, pattern, same), strict=True):
                x += tail
                n = len(x) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(x[4 * a : 4 * b])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): which lengths share a sequence, and how many such sequences.

    Lengths index the table of how many are left, which so holds the single sums; a sum of two or three has one
    look-up for its last partner. From the longest length down, the gap that it leaves is looked up among single lengths,
    then among sums of two, then of three; a combination that fills the gap exactly is used as often as
    all its lengths last. Of c pieces of a length the square root of c, rounded up, aren't available for this: so all lengths remain for
    the residuals, which go best-fit: each, longest first, into the open sequences with the least room that holds it. The plan's
    work depends on the number of different lengths, which capacity bounds, not on the number of pieces.
    """
    reserve = {n: math.isqrt(c - 1) + 1 for n, c in counts.items() if 0 < c and n < capacity}
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c - reserve.get(n, 0)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*combo: int) -> None:
        need = defaultdict(int)
        for n in combo:
            need[n] += 1
        if times := min(int(left[n]) // k for n, k in need.items()):
            for n, k in need.items():
                left[n] -= k * times
            out.append((combo, times))

    def fill_two(n: int, gap: int, *more: int) -> None:
        """Pairs whose sum is the gap, the longer one first and no longer than what stands before it."""
        b = np.arange(min(gap - 1, *more) if more else gap - 1, (gap + 1) // 2 - 1, -1)
        for x in b[(left[b] > 0) & (left[gap - b] > 0)].tolist() if len(b) else ():
            if not left[n] or (more and not left[more[0]]):
                return
            use(n, *more, x, gap - x)

    if left[capacity]:
        use(capacity)
    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        if left[n] and left[gap]:
            use(n, gap)
        if left[n] and gap > 1:
            fill_two(n, gap)
        for a in np.flatnonzero(left[: max(0, gap - 1)])[::-1].tolist():
            if not left[n] or 3 * a < gap:
                break
            if left[a]:
                fill_two(n, gap - a, a)
    rest = {n: int(left[n]) + reserve.get(n, 0) for n in counts}
    return out + _best_fit({n: c for n, c in rest.items() if c}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of equally filled sequences."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for n in sorted(left, reverse=True):
        count = left[n]
        while count and (open_ := [r for r in room if r >= n and room[r]]):
            space = min(open_)
            combo, have = room[space].popitem()
            taken = min(have, count)
            if have > taken:
                room[space][combo] = have - taken
            count -= taken
            room[space - n][(*combo, n)] += taken
        if count:
            each = capacity // n
            if count // each:
                room[capacity - n * each][(n,) * each] += count // each
            if count % each:
                room[capacity - n * (count % each)][(n,) * (count % each)] += 1
    return [(combo, times) for combos in room.values() for combo, times in combos.items() if times]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts(doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of one length are interchangeable, so only the histogram of lengths (capacity rows at
    most) goes to the driver, is planned there, and comes back as runs: the pieces of a length
    numbered from `low` to `high` stand at `offset` in sequences that follow one another. Pieces
    are numbered by doc_id and piece within shares of each length; a length has shares in
    proportion to its pieces, about one in SHARES of all pieces each, so that one with a third of all is
    numbered by many tasks. Both broadcasts are bounded by capacity and SHARES, whatever the input.
    parts should be a staged table, as it is read several times. Repeated rows are pieces of
    their own; no rows give no rows.
    """
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count("*")).collect()}
    total = sum(counts.values())
    runs, used, sequence = [], defaultdict(int), 0
    for combo, times in plan(counts, capacity):
        offset = 0
        taken = defaultdict(int)
        for n in combo:
            low = used[n] + taken[n]
            runs.append((n, low, low + times, sequence - low, offset))
            taken[n] += times
            offset += n
        for n, t in taken.items():
            used[n] += t
        sequence += times
    runs_df = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, low long, high long, shift long, offset long")
    shares = spark.createDataFrame([(n, -(-c * SHARES // total)) for n, c in counts.items()] or [(0, 1)], "length long, shares long")
    dealt = parts.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "shares"))
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(sizes.select("length", "share", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    place = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(place) - 1).join(F.broadcast(starts), ["length", "share"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    own = numbered["length"] == runs_df["length"]
    placed = numbered.join(F.broadcast(runs_df), own & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return placed.select("doc_id", "piece", "start", numbered["length"], "ids_crc32", (F.col("number") + F.col("shift")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text, ...) cut into pieces and packed; see pieces and pack."""
    return pack(staged(pieces(docs, tokenizer, pattern, end_id, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
