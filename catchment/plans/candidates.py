"""Many noise settings scored in one pass: the candidates are an axis of the filter's arrays, and the sums over windows are formed where the rows are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, span_of
from ..operators.filtering import NAMES, OBSERVED, WaterBalance, process_bases
from ..operators.linear import apply_element, by_groups, composed_groups, doubles, elements_of, filtered_groups, groups_of, in_step, log_density, packed, step_elements, unpacked
from ..operators.prepare import in_windows
from ..operators.scores import validity
from ..sources.shared import staged
from .config import ScoreSettings, SeriesConfig

#: Rows times candidates that a task filters at once.
BLOCK_ROWS = 200_000
SUMS = "joint_sum double, joint_count long, storage_count long, unscorable_count long"


@dataclass(frozen=True)
class Candidate:
    """One setting of the five variances: of storage, inflow and outflow, and of both readings."""

    values: tuple[float, ...]

    def config(self, base: SeriesConfig) -> SeriesConfig:
        return base.with_noise(q=self.values[:3], r=self.values[3:])


def of_config(config: SeriesConfig) -> Candidate:
    return Candidate((config.q[0][0], config.q[1][1], config.q[2][2], config.r[0][0], config.r[1][1]))


def windowed_steps(step_rows: DataFrame, windows: DataFrame, settings: ScoreSettings, span: int = SPAN_US) -> tuple[DataFrame, bool]:
    """(step rows with their span and `name`, the window in which a row counts, null if in none; whether no series has two spans), written once for all passes."""
    warm = int(settings.warmup.total_seconds() * 1e6)
    counted = step_rows.filter((F.col("us") > F.col("second_us")) & (F.col("us") >= F.col("second_us") + warm)).select("series", "us")
    named = in_windows(counted, windows)
    columns = ["series", "us", "storage", "outflow", "dt", "first_storage", "first_outflow"]
    rows = staged(step_rows.select(*columns, span_of("us", span).alias("span")).join(named, ["series", "us"], "left"), "windowed")
    single = rows.groupBy("series").agg(F.min("span").alias("a"), F.max("span").alias("b")).filter("a < b").isEmpty()
    return rows, single


class Kernel:
    """The filter's arrays of a block of step rows for all candidates, one after the other along the rows."""

    def __init__(self, config: SeriesConfig, candidates: list[Candidate]):
        self.model = WaterBalance(config)
        self.values = np.array([c.values for c in candidates])
        self.count = len(candidates)
        self.rest = np.array(config.q) - np.diag(np.diag(config.q))
        self.rest_r = np.array(config.r) - np.diag(np.diag(config.r))

    def inputs(self, df: pd.DataFrame) -> tuple[np.ndarray, ...]:
        k, n = self.count, len(df)
        bases = process_bases(np.nan_to_num(df["dt"].to_numpy(dtype=float)), self.model.c)
        q = np.einsum("kb,nbij->knij", self.values[:, :3], bases[:, [0, 4, 8]]) + np.einsum("b,nbij->nij", self.rest.ravel(), bases)
        q[:, df["dt"].isna().to_numpy()] = np.asarray(self.model.config.p0)
        f = self.model.transitions(df)
        r = self.rest_r + self.values[:, 3:, None] * np.eye(2)
        y = df[["storage", "outflow"]].to_numpy(dtype=float)
        return np.tile(y, (k, 1)), np.tile(f, (k, 1, 1)), q.reshape(k * n, 3, 3), np.broadcast_to(OBSERVED, (k * n, 2, 3)), np.repeat(r, n, axis=0)

    def groups(self, start: np.ndarray, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        return (start + rows * np.arange(self.count)[:, None]).ravel(), np.tile(size, self.count)


def _span_states(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """(series, span, candidate, m0 ..): the state before each span, for each candidate."""
    keep = ["series", "span", "first_storage", "first_outflow"]

    def elements(df: pd.DataFrame) -> pd.DataFrame:
        start, size = groups_of(df, ["series", "span"])
        out = composed_groups(step_elements(*kernel.inputs(df)), *kernel.groups(start, size, len(df)))
        flat = np.hstack([x.reshape(len(x), -1) for x in out])
        head = pd.concat([df.iloc[start][keep]] * kernel.count, ignore_index=True)
        return pd.concat([pd.DataFrame(flat, columns=NAMES.element), head.assign(candidate=np.repeat(np.arange(kernel.count), len(start)))], axis=1)

    def states(df: pd.DataFrame) -> pd.DataFrame:
        parts = elements_of(df, 3)
        start, size = groups_of(df, ["series", "candidate"])
        m, p = kernel.model.initial(df.iloc[start])[0], np.zeros((len(start), 3, 3))
        means, covs = np.empty((len(df), 3)), np.empty((len(df), 3, 3))
        for groups, at in in_step(start, size):
            means[at], covs[at] = m[groups], p[groups]
            m[groups], p[groups] = apply_element(m[groups], p[groups], tuple(v[at] for v in parts))
        return pd.concat([pd.DataFrame(np.hstack([means, packed(covs)]), columns=NAMES.state), df[["series", "span", "candidate"]].reset_index(drop=True)], axis=1)

    block = BLOCK_ROWS // kernel.count
    found = by_groups(rows, ["series", "span"], "us", elements, f"{doubles(NAMES.element)}, series string, span long, first_storage double, first_outflow double, candidate int", block)
    return by_groups(found, ["series", "candidate"], "span", states, f"{doubles(NAMES.state)}, series string, span long, candidate int")


def candidate_sums(rows: DataFrame, single: bool, config: SeriesConfig, candidates: list[Candidate]) -> DataFrame:
    """(candidate, series, name, joint_sum, joint_count, storage_count, unscorable_count) for windowed_steps, summed over the counted rows of each window.

    The rows are shuffled once whatever the number of candidates, and once more where series have several spans; the states before
    a span come to its task as rows ahead of its own. joint_sum is the negative logarithm of the readings' joint density.
    """
    kernel = Kernel(config, candidates)
    own = rows.withColumn("candidate", F.lit(None).cast("int"))
    if not single:
        ahead = _span_states(rows, kernel).withColumn("us", F.lit(-(1 << 62)).cast("long"))
        own = own.unionByName(ahead, allowMissingColumns=True)

    def work(df: pd.DataFrame) -> pd.DataFrame:
        sent = df["candidate"].notna().to_numpy()
        data, heads = df[~sent].reset_index(drop=True), df[sent].sort_values(["candidate", "series", "span"], kind="stable")
        start, size = groups_of(data, ["series", "span"])
        if len(heads):
            # Groups come in the order of series and span, in the data as in the heads of each candidate.
            m, p = heads[NAMES.mean].to_numpy(dtype=float), unpacked(heads[NAMES.cov].to_numpy(dtype=float))
        else:
            m = np.tile(kernel.model.initial(data.iloc[start])[0], (kernel.count, 1))
            p = np.zeros((len(m), 3, 3))
        inputs = kernel.inputs(data)
        *_, v, s = filtered_groups(m, p, inputs, *kernel.groups(start, size, len(data)))
        seen = np.isfinite(inputs[0])
        read = seen.sum(axis=1)
        loss = -log_density(v, s, read)
        good = np.isfinite(loss) & (read > 0)
        flat = pd.DataFrame({"candidate": np.repeat(np.arange(kernel.count), len(data)), "series": np.tile(data["series"].to_numpy(), kernel.count), "name": np.tile(data["name"].to_numpy(), kernel.count)})
        flat = flat.assign(joint_sum=np.where(good, loss, 0.0), joint_count=np.where(good, read, 0), storage_count=(good & seen[:, 0]).astype(np.int64), unscorable_count=(~good & (read > 0)).astype(np.int64))
        return flat[flat["name"].notna()].groupby(["candidate", "series", "name"], as_index=False).sum()

    parts = by_groups(own, ["series", "span"], "us", work, f"candidate int, series string, name string, {SUMS}", BLOCK_ROWS // kernel.count)
    return parts.groupBy("candidate", "series", "name").agg(*[F.sum(c).alias(c) for c in ("joint_sum", "joint_count", "storage_count", "unscorable_count")])


def mean_loss() -> Column:
    """The mean joint density a reading of candidate_sums' rows; null for a window whose counted rows have no reading."""
    return F.when(F.col("joint_count") > 0, F.col("joint_sum") / F.col("joint_count"))


def objective(sums: DataFrame, count: int, windows: DataFrame, settings: ScoreSettings) -> DataFrame:
    """(candidate, series, objective, total, reasons): the weighted mean of the windows' joint densities a reading, null if not valid, and their sum over all readings without weights.

    Windows with few readings or none make an objective invalid but not a total, which has what readings there are; it is null only if rows couldn't be scored.
    """
    every = windows.select("series", "name", "weight", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("candidate"))
    rows = every.join(sums, ["candidate", "series", "name"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("joint_count", "storage_count", "unscorable_count")})
    rows = rows.withColumn("joint_nlpd", mean_loss())
    ok = validity(rows, settings, ("candidate",))
    mean = rows.groupBy("series", "candidate").agg(F.sum(F.col("joint_nlpd") * F.col("weight")).alias("mean"), F.sum(F.coalesce("joint_sum", F.lit(0.0))).alias("sum"), F.sum("unscorable_count").alias("unscorable"))
    total = F.when(F.col("unscorable") == 0, F.col("sum")).alias("total")
    return ok.join(mean, ["series", "candidate"]).select("candidate", "series", F.when(F.col("valid"), F.col("mean")).alias("objective"), total, "reasons")
