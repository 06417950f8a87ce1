"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_slices, whole_text, without

#: Folds of the labelled rows; fold 0 is held out and never learnt from.
FOLDS = 5
#: A document with a score of at least so much is accepted.
ACCEPT = 0.3
#: Random features, the kernel's width in standard deviations, ridge penalty per row, and seed.
FEATURES, WIDTH, PENALTY, SEED = 256, 4.0, 1e-3, 17
#: Raw scores are summed up in so many bins for the calibration.
BINS = 4096

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "letters", "capitals", "digits", "spaces", "newlines", "sentence_marks",
    "bars", "exclamations", "symbols", "other_bytes", "distinct_words", "repeated_words", "shouted_words", "longest_run", "short_words", "line_length", "log_distinct_bytes",
)

_KIND = np.full(256, 9, dtype=np.int64)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r", b"\n", b".,;:?'-", b"|", b"!", range(128, 256))):
    _KIND[list(_bytes)] = _kind


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each UTF-8 text; all are shares, means or logarithms, and zero for an empty text."""
    values = texts.to_pylist()
    out = np.zeros((len(values), len(STATISTICS)))
    for row, text in zip(out, values, strict=True):
        n = len(text)
        if not n:
            continue
        raw = np.frombuffer(text, dtype=np.uint8)
        seen = np.bincount(raw, minlength=256)
        kinds = np.bincount(_KIND, weights=seen, minlength=10) / n
        words = text.split()
        w = max(1, len(words))
        runs = list(map(eq, words, words[1:]))
        lines = text.count(b"\n") + 1
        row[:] = (
            np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, kinds[0] + kinds[8], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
            kinds[6], kinds[7], kinds[9], kinds[8], len(set(words)) / w, sum(runs) / w, sum(map(bytes.isupper, words)) / w, _longest(runs) / w, sum(len(x) < 3 for x in words) / w, np.log1p(n / lines), np.log1p(np.count_nonzero(seen)),
        )
    return out


def _longest(flags: list[bool]) -> int:
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def with_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, carried..., x) with x the STATISTICS of each row of docs(doc_id, text, carried..., ...); carried are longs. Null texts count as empty; no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            x = statistics(texts)
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    return docs.select(F.struct("doc_id", *carried).alias("id"), "text").mapInArrow(rows, f"id {_id_type(carried)}, x array<double>").select("id.*", "x")


def _id_type(carried: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{c}: bigint" for c in ("doc_id", *carried)) + ">"


@dataclass
class Model:
    """What scoring needs; its size depends on FEATURES and BINS only."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(random_features(x, self.mean, self.scale) @ self.weights, self.knots, self.levels)


def random_features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(Wz + b) of the standardised rows, and a constant; inner products approach a Gaussian kernel."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -20, 20)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _summed(rows: DataFrame) -> DataFrame:
    """rows(part, v) added up elementwise per part, in two rounds, so that no task gets more than a few dozen arrays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.asarray(v.values)
                totals[part] = totals[part] + x if part in totals else x.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], ["part", "v"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    once = rows.mapInArrow(add, "part int, v array<double>")
    return once.repartition(n).mapInArrow(add, "part int, v array<double>") if n > 1 else once


def _gathered(rows: DataFrame) -> dict[int, np.ndarray]:
    totals: dict[int, np.ndarray] = {}
    for part, v in _summed(rows).toLocalIterator():
        x = np.array(v)
        totals[part] = totals[part] + x if part in totals else x
    return totals


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing levels closest to sums / counts, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts, strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, k = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][2] += k
    return np.concatenate([np.full(int(k), s / c) for s, c, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame) -> Model | None:
    """A model from labelled(x, y, fold), fold 1 to FOLDS - 1; None without rows.

    Three passes of fixed-size sums over all labelled rows: means and deviations; normal equations
    by fold; and, for every row, the raw score by the equations of the other folds, summed in bins with its label. The
    driver gets these sums only, solves FEATURES + 1 equations, and pools the bins into a non-decreasing curve.
    """
    k = len(STATISTICS)

    def moments(batches):
        for batch in batches:
            x = _matrix(batch.column(0), k)
            if len(x):
                v = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["part", "v"])

    found = _gathered(labelled.select("x").mapInArrow(moments, "part int, v array<double>"))
    if not found:
        return None
    n, total, squares = found[0][0], found[0][1 : k + 1], found[0][k + 1 :]
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 1e-12)) + 1e-6
    d = FEATURES + 1

    def equations(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _matrix(batch.column(0), k), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            z = random_features(x, mean, scale)
            for f in np.unique(fold).tolist():
                own = z[fold == f]
                v = np.concatenate([(own.T @ own).ravel(), own.T @ y[fold == f], [len(own)]])
                sums[f] = sums[f] + v if f in sums else v
        for f, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["part", "v"])

    by_fold = _gathered(labelled.select("x", "y", "fold").mapInArrow(equations, "part int, v array<double>"))
    whole = sum(by_fold.values())

    def solved(v: np.ndarray) -> np.ndarray:
        return np.linalg.solve(v[: d * d].reshape(d, d) + np.eye(d) * (PENALTY * v[-1] + 1e-3), v[d * d : -1])

    weights = solved(whole)
    others = {f: solved(whole - v) if len(by_fold) > 1 else weights for f, v in by_fold.items()}

    def binned(batches):
        for batch in batches:
            x, y, fold = _matrix(batch.column(0), k), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            z = random_features(x, mean, scale)
            raw = (z * np.stack([others[f] for f in fold.tolist()])).sum(axis=1)
            place = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            v = np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS), np.bincount(place, weights=raw, minlength=BINS)])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["part", "v"])

    counts, ones, raws = _gathered(labelled.select("x", "y", "fold").mapInArrow(binned, "part int, v array<double>"))[0].reshape(3, BINS)
    full = counts > 0
    levels = isotonic(ones[full], counts[full])
    knots = raws[full] / counts[full]
    # Each level stands at its block's mean raw score; scores in between are interpolated, so they keep their order.
    starts = np.flatnonzero(np.concatenate([[True], np.diff(levels) > 0]))
    weight, where = np.add.reduceat(counts[full], starts), np.add.reduceat(raws[full], starts)
    return Model(mean, scale, weights, *(_spread(where / weight, levels[starts], knots)))


def _spread(centres: np.ndarray, levels: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve through the blocks' centres, carried on to 0 and 1 well outside of all raw scores seen."""
    return np.concatenate([[knots[0] - 1], centres, [knots[-1] + 1]]), np.concatenate([[0.0], levels, [1.0]])


def fold_of(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", *carried: str) -> DataFrame:
    """(doc_id, carried..., held_out, score, predicted) for each row of docs(doc_id, text, carried..., ...).

    The model learns from labels(doc_id, <label>) of 0 or 1, fold 0 held out; other labels
    count as none, of several labels of one id the largest counts. Nothing but the
    text goes into a score; null texts count as empty. Without any label to learn from all
    scores are 0.5. A null doc_id is held out. Repeated rows are scored alike; no rows give no rows. A long text's statistics are
    taken whole by one task, with its words as a list.
    """
    x = staged(with_statistics(docs, *carried), "statistics")
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    labelled = x.join(known, "doc_id").withColumn("fold", fold_of()).filter("fold > 0").select("x", "y", "fold")
    model = fit(staged(labelled, "labelled"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch.column(1), len(STATISTICS))
            scores = np.clip(model.score(stats), 0, 1) if model else np.full(len(stats), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    scored = x.select(F.struct("doc_id", *carried).alias("id"), "x").mapInArrow(rows, f"id {_id_type(carried)}, score double").select("id.*", "score")
    return scored.select("doc_id", *carried, F.coalesce(fold_of() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects (score under ACCEPT); columns unchanged.

    A row is told apart by its doc_id and text, so of several rows of one id, or without an id, each goes by its own
    score. Only rows that may go are shuffled.
    """
    own = docs.withColumn("__row", F.xxhash64("doc_id", F.xxhash64(whole_text())))
    rejected = staged(score(own, labels, "quality", "__row").filter("predicted = 0").select("__row").distinct(), "rejected")
    return without(own, rejected, "__row").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
