"""Vectors as short codes: four parts, each the number of its nearest entry in a codebook, learnt and searched in integers.

The search works on integer Walsh-Hadamard transforms of parts and entries, zero-padded to a power of two N. The transform keeps squared
distances but for a factor of N and gathers what is smooth in the first of its coefficients in sequency order; so partial sums of squared
differences soon exceed the distance of a known entry, and such entries are left. No floating point enters after the components have become integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are searched at once.
SEARCHED = 2048
#: Quarters of the coefficients that are summed for all entries before the first are left (numpy adds a block of entries in the time of gathering a sixth of them), and coefficients by which survivors are held against the known distance before the next.
FIRST, STEP = 3, 4


def transform(rows: np.ndarray, size: int) -> np.ndarray:
    """Walsh-Hadamard transforms of integer rows, zero-padded to size (a power of two), in sequency order."""
    out = np.zeros((len(rows), size), dtype=np.int64)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(out), size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
        half *= 2
    return out[:, sequency_order(size)]


def sequency_order(size: int) -> np.ndarray:
    """Places, in the order that the butterflies leave, of the coefficients with 0, 1, 2, ... changes of sign: bits reversed, of the Gray code."""
    bits = size.bit_length() - 1
    k = np.arange(size)
    gray, out = k ^ (k >> 1), np.zeros(size, dtype=np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, its squared distance) of each row: the lower number of equal distances, exactly, by transforms (see above)."""
    size = 1 << max(0, parts.shape[1] - 1).bit_length()
    known = transform(entries, size)
    numbers, distances = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    first = max(1, size * FIRST // 4)
    for begin in range(0, len(parts), SEARCHED):
        own = transform(parts[begin : begin + SEARCHED], size)
        partial = np.zeros((len(own), len(known)), dtype=np.int64)
        for s in range(first):
            gap = own[:, s, None] - known[None, :, s]
            gap *= gap
            partial += gap
        guess = partial.argmin(axis=1)
        rest = own[:, first:] - known[guess, first:]
        bound = partial[np.arange(len(own)), guess] + (rest * rest).sum(axis=1)
        row, entry = np.nonzero(partial <= bound[:, None])
        total = partial[row, entry]
        for s in range(first, size, STEP):
            gap = own[row, s : s + STEP] - known[entry, s : s + STEP]
            total = total + (gap * gap).sum(axis=1)
            alive = total <= bound[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        # Rows and entries ascend, and each row's guess is still there.
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(total, starts)
        hits = np.flatnonzero(total == np.repeat(least, np.diff(np.append(starts, len(row)))))
        _, lowest = np.unique(row[hits], return_index=True)
        numbers[begin : begin + len(own)] = entry[hits[lowest]]
        distances[begin : begin + len(own)] = least // size
    return numbers, distances


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(the usable rows with the vector as integers floor(SCALE x) in `__v`, the width of a part).

    Vectors shorter than the longest, and a length that PARTS doesn't divide, are filled up with zeros. Integers are kept
    within 2^30 over the padded width, so that no squared distance leaves a long (for 64 components that is |x| < 65,536).
    """
    kept = rows.filter(usable(vector))
    width = max(1, -(-(kept.agg(F.max(F.size(vector))).first()[0] or 0) // PARTS))
    limit = float((1 << 30) >> max(0, width - 1).bit_length())
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit)), F.lit(-limit))).cast("int"))
    return kept.withColumn("__v", F.concat(whole, F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size(vector)))), width


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their parts as an array of rows x PARTS x width)."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch["__v"].flatten().to_numpy().astype(np.int64).reshape(-1, PARTS, width)


def first_codebooks(kept: DataFrame, width: int, by: str, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the `entries` smallest ids (null last; of equal ids the smaller vectors), as PARTS x entries x width."""
    rows = kept.select(by, "__v").orderBy(F.col(by).asc_nulls_last(), "__v").limit(entries).collect()
    return np.array([r["__v"] for r in rows], dtype=np.int64).reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes its parts' mean, rounded down by component; entries without parts stay.

    A task sends one row of sums for each entry that it met, and the driver gets one row an entry.
    """
    width = books.shape[2]
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        count, total = np.zeros(own.shape[:2], dtype=np.int64), np.zeros(own.shape, dtype=np.int64)
        for _, parts in _blocks(batches, width):
            for p in range(PARTS):
                number, _ = nearest(parts[:, p], own[p])
                order = np.argsort(number, kind="stable")
                met, starts = np.unique(number[order], return_index=True)
                count[p] += np.bincount(number, minlength=own.shape[1])
                total[p, met] += np.add.reduceat(parts[order, p], starts, axis=0)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "count": count[part, entry], "total": pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), width).cast(pa.list_(pa.int64()))})

    sums = kept.select("__v").mapInArrow(work, "part int, entry int, count long, total array<long>")
    found = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]).collect()
    out = books.copy()
    for r in found:
        out[r["part"], r["entry"]] = [r[f"t{i}"] // r["count"] for i in range(width)]
    shared.destroy()
    return out


def compress(rows: DataFrame, vector: str = "embedding", by: str = "vec_id", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(the usable rows with code and error in place of the vector, the codebooks).

    code: two hex digits a part; error: the squared distances to the entries, summed over the parts. Codebooks start as the parts of the rows of the smallest
    ids. Rows with a null vector, or with a component that is null or not finite, are left out; null ids come last, repeated rows count each; other columns
    stay; no rows give no rows. The driver holds the codebooks only, of a fixed number of entries.
    """
    kept, width = whole_numbers(rows, vector)
    kept = staged(kept.drop(vector), "vectors")
    books = first_codebooks(kept, width, by)
    if books.shape[1]:
        for _ in range(rounds):
            books = refined(kept, books)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    names = [c for c in kept.columns if c != "__v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in _blocks(batches, width):
            found = [nearest(parts[:, p], shared.value[p]) for p in range(PARTS)]
            codes = np.stack([number for number, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], names=[*names, "__code", "__error"])

    schema = ", ".join([*[f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names], "__code string, __error long"])
    out = kept.mapInArrow(work, schema).drop("code", "error").withColumnsRenamed({"__code": "code", "__error": "error"})
    return out, books


def books_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and place, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    out, books = compress(rows)
    coded = staged(out, "codes")
    # One row a label; a sum beyond a long is null.
    labels = staged(coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error")), "labels")
    mark = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(labels, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(mark).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """The same as relations of (row, part, place, x) and (part, entry, place, y): every round is a join of all parts with all entries."""

    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT r, part, min(entry) AS entry, min(e) AS e FROM (SELECT r, part, entry, e, min(e) OVER (PARTITION BY r, part) AS least FROM
  (SELECT v.r, v.part, entry, sum((x - y) * (x - y)) AS e FROM v JOIN c{k} USING (part, place) GROUP BY v.r, v.part, entry)) WHERE e = least GROUP BY r, part)"""

    def book(k: int) -> str:
        mean = "(t - ((t % n) + n) % n) // n"
        return f"""c{k + 1} AS (SELECT c.part, c.entry, c.place, CAST(coalesce({mean}, c.y) AS BIGINT) AS y FROM c{k} c LEFT JOIN
  (SELECT part, entry, place, sum(x) AS t, count(*) AS n FROM v JOIN a{k} USING (r, part) GROUP BY part, entry, place) m ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)"""

    rounds = ",\n".join(f"{assigned(k)},\n{book(k)}" for k in range(ROUNDS))
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) // {PARTS} AS width FROM k),
v AS (SELECT r, i // width AS part, i % width AS place, x FROM u),
c0 AS (SELECT part, r AS entry, place, x AS y FROM v WHERE r < {ENTRIES}),
{rounds},
{assigned(ROUNDS)},
coded AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(e) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN k USING (r)"""


OP11_SQL = _op11_sql()
