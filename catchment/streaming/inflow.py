"""The filter and fixed-lag smoother as a Structured Streaming query whose state is an anchor and the readings behind it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.estimate import NON_SMOOTHED, NORMAL, PREDICTED, SMOOTHED
from ..operators.filtering import WaterBalance
from ..operators.linear import Model, Names, applied, backward_functions, backward_parts, by_groups, doubles, filtered_groups, groups_of, kernel_inputs, names_of, packed, scans, swept_groups, unpacked
from ..plans.config import SeriesConfig

OUTPUT = "series string, us long, kind string, value double, prediction_flag string, smoothing_flag string, standard_deviation double, reason string"
#: The state after the last released row (anchor: mean, then covariance by its upper triangle), the first reading until there is a second, the last time, and the number of the next chunk.
HEAD = "fingerprint string, last_us long, first_us long, first array<double>, anchor_us long, anchor array<double>, chunk long"
#: Readings of one micro-batch that wait for release, a value a reading and column in time order.
CHUNK = "us array<long>, readings array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE, BARE = "not later than the last reading", "the first storage reading needs an outflow"


def _rows(model: Model, us: np.ndarray, y: np.ndarray, before_us: int | None) -> pd.DataFrame:
    """Step rows of one series: dt is missing for its first row; first_... are that row's readings."""
    dt = np.diff(us, prepend=us[0] if before_us is None else before_us) / 1e6
    if before_us is None:
        dt[0] = np.nan
    frame = pd.DataFrame(y, columns=list(model.reads)).assign(us=us, dt=dt)
    return frame.assign(**{f"first_{c}": y[0, i] for i, c in enumerate(model.reads)})


class Estimator(StatefulProcessor):
    """One series' part of the stream.

    A batch's readings are filtered on from the anchor after those that wait (which are filtered again, so their states need not be kept), and rows are
    released by block functions as in linear.smoothed_by_lag, whose gains are solved once a batch. Written are the head, one chunk of new readings,
    and the removal of chunks that are released as a whole; so a batch writes what it changes.
    """

    def __init__(self, model: Model, lag_us: int, shown: int, mark: str, max_window: int, start_on: str | None):
        self.model, self.lag, self.shown, self.mark, self.most = model, lag_us, shown, mark, max_window
        self.start = model.reads.index(start_on) if start_on is not None else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.waiting = handle.getMapState("waiting", "chunk long", CHUNK)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        reads = list(self.model.reads)
        new = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable")
        last_us = first_us = first = anchor_us = anchor = None
        chunk = 0
        if self.head.exists():
            known, last_us, first_us, first, anchor_us, anchor, chunk = self.head.get()
            if known != self.mark:
                raise ValueError("the stored state belongs to another configuration")
        held = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        started = bool(held) or anchor_us is not None
        out, us, y = [], [], []
        for t, *values in zip(new["us"].tolist(), *(new[c].astype(float).tolist() for c in reads), strict=True):
            if last_us is not None and t <= last_us:
                out.append((t, LATE))
                continue
            if not started and self.start is not None:
                if not np.isfinite(values[self.start]):
                    last_us = t
                    continue
                if first_us is None:
                    if not np.isfinite(values).all():
                        out.append((t, BARE))
                        continue
                    last_us, first_us, first = t, t, values
                    continue
                us, y = [first_us], [list(first)]
                first_us = first = None
            started, last_us = True, t
            us.append(t)
            y.append(values)
        parts = [self._columns([t for t, _ in out], "rejected", np.nan, None, None, np.nan, [why for _, why in out])] if out else []
        if us:
            old_us = [t for _, times, _ in held for t in times]
            old_y = [v for _, _, values in held for v in values]
            all_us = np.array(old_us + us, dtype=np.int64)
            all_y = np.vstack([np.array(old_y, dtype=float).reshape(-1, len(reads)), np.array(y, dtype=float)])
            behind = 0 if anchor_us is None else int(np.searchsorted(all_us, anchor_us, side="right"))
            all_us, all_y = all_us[behind:], all_y[behind:]
            found, anchor_us, anchor = self._advance(all_us, all_y, len(old_us) - behind, anchor_us, anchor)
            parts += found
            edge = anchor_us if anchor_us is not None else np.iinfo(np.int64).min
            for number, times, _ in held:
                if times[-1] <= edge:
                    self.waiting.removeKey((number,))
            fresh = [(t, v) for t, v in zip(us, y, strict=True) if t > edge]
            if fresh:
                self.waiting.updateValue((chunk,), ([t for t, _ in fresh], [float(x) for _, v in fresh for x in v]))
                chunk += 1
        self.head.update((self.mark, last_us, first_us, first, anchor_us, anchor, chunk))
        if parts:
            whole = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
            # Strings as plain objects: Spark's serializer for these functions takes no chunked columns.
            yield pd.DataFrame({"series": pd.Series([key[0]] * len(whole["us"]), dtype=object)} | {c: pd.Series(v, dtype=v.dtype) for c, v in whole.items()})

    def _advance(self, us: np.ndarray, y: np.ndarray, old: int, anchor_us: int | None, anchor: list | None) -> tuple[list[dict[str, np.ndarray]], int | None, list | None]:
        """(columns of output rows, the anchor's time and state) of readings of which the first `old` were there before."""
        n = self.model.states
        rows = _rows(self.model, us, y, anchor_us)
        m, p = (self.model.initial(rows.iloc[:1])[0], np.zeros((1, n, n))) if anchor_us is None else (np.array([anchor[:n]]), unpacked(np.array([anchor[n:]])))
        one = np.array([0]), np.array([len(us)])
        inputs = kernel_inputs(rows, self.model)
        bm, bp, m, p, _, _ = filtered_groups(m.copy(), p.copy(), inputs, *one)
        flag = np.where(np.isfinite(y).all(axis=1), NORMAL, PREDICTED)
        out = [self._frame(us[old:], "filtered", m[old:], p[old:], flag[old:], NON_SMOOTHED)]
        active = np.arange(len(us)) - np.searchsorted(us, us - self.lag, side="right") + 1
        if (active[old:] > self.most).any():
            raise OverflowError("more rows than max_window wait for release")
        last = np.searchsorted(us, us + self.lag, side="left") - 1
        released = int((last < len(us) - 1).sum())
        if released:
            # The row behind each; the last has none.
            behind = [np.roll(x, -1, axis=0) for x in (bm, bp, inputs[1])]
            parts = backward_parts(m, p, *behind, np.arange(len(us)) < len(us) - 1)
            block = us // self.lag
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ahead, so_far = scans(parts, start, np.diff(np.append(start, len(us))))
            at = last[:released]
            sm, sp = m[at + 1].copy(), p[at + 1].copy()
            far = np.flatnonzero(block[at] != block[:released])
            sm[far], sp[far] = applied(tuple(x[at[far]] for x in so_far), sm[far], sp[far])
            sm, sp = applied(tuple(x[:released] for x in ahead), sm, sp)
            out.append(self._frame(us[:released], "revised", sm, sp, flag[:released], SMOOTHED))
            anchor_us, anchor = int(us[released - 1]), [*m[released - 1].tolist(), *packed(p[released - 1 : released])[0].tolist()]
        return out, anchor_us, anchor

    def _frame(self, us, kind, m, p, flag, smoothing) -> dict[str, np.ndarray]:
        return self._columns(us, kind, m[:, self.shown], flag, smoothing, np.sqrt(np.maximum(p[:, self.shown, self.shown], 0)), None)

    @staticmethod
    def _columns(us, kind, value, flag, smoothing, deviation, reason) -> dict[str, np.ndarray]:
        """The columns of OUTPUT but series, each given by row or as one value."""
        given = {"us": (us, np.int64), "kind": (kind, object), "value": (value, float), "prediction_flag": (flag, object), "smoothing_flag": (smoothing, object), "standard_deviation": (deviation, float), "reason": (reason, object)}
        out = {c: np.empty(len(us), dtype=kind) for c, (_, kind) in given.items()}
        for c, (x, _) in given.items():
            out[c][:] = x
        return out


def _with_behind(names: Names, model: Model, rows: pd.DataFrame, bm, bp, m, p) -> pd.DataFrame:
    """The rows as linear.backward_functions reads them: each with the row behind it."""
    own = pd.DataFrame(np.hstack([bm, packed(bp), m, packed(p)]), columns=names.before + names.state)
    both = pd.concat([own, rows[list(dict.fromkeys(["us", "dt", *model.moves]))].reset_index(drop=True)], axis=1)
    return pd.concat([both, both.shift(-1).add_prefix("n_")], axis=1)


def stream_states(readings: DataFrame, model: Model, lag_us: int, shown: int, mark: str, max_window: int = 100_000, start_on: str | None = None) -> DataFrame:
    """Output rows (OUTPUT) for a stream of readings(series, us, model.reads), for any linear.Model whose matrices are constants or follow from dt.

    value is state number `shown`. start_on: a reading whose first two rows start a series (rows between are left out; the first needs all
    readings); without it a series starts with its first row. mark names the model: a query with another mark fails on stored state. See stream_estimates.
    The state store is RocksDB's with change logs, which this sets for the session: entries of a map are written one by one, and a batch stores its changes only.
    """
    known = {"dt", *(f"first_{c}" for c in model.reads)}
    extra = [c for c in (*model.moves, *model.needs) if c not in known]
    if extra:
        raise ValueError(f"a stream keeps readings only, so matrices can't come from columns: {', '.join(extra)}")
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    work = Estimator(model, lag_us, shown, mark, max_window, start_on)
    return readings.select("series", "us", *model.reads).groupBy("series").transformWithStateInPandas(work, OUTPUT, "append", "none")


def stream_estimates(readings: DataFrame, config: SeriesConfig) -> DataFrame:
    """Output rows (OUTPUT) for a stream of readings(series, us, storage, outflow), appended as they come.

    Each reading gives a row of kind filtered, and rows of kind revised for those that are now at least the lag
    older. Readings of a micro-batch are taken in time order; one that is not later than the series' last,
    or a first storage reading without outflow, gives a row of kind rejected and changes nothing. The
    state (see Estimator) lives in Spark's state store, so a restarted query goes on where it was; a
    query with another model fails on it. Nulls are missing readings.
    """
    return stream_states(readings, WaterBalance(config), config.lag_us, 1, config.fingerprint(), config.max_window, "storage")


def waiting_readings(spark: SparkSession, checkpoint: str, reads: tuple[str, ...] = WaterBalance.reads) -> DataFrame:
    """(series, us, readings, anchor_us, anchor) of the rows that wait for release, out of the state of a stopped stream with the checkpoint folder."""
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    heads = state("head").load().select(F.col("key.series").alias("series"), "value.anchor_us", "value.anchor")
    chunks = state("waiting").option("flattenCollectionTypes", "true").load().select(F.col("key.series").alias("series"), F.posexplode("user_map_value.us").alias("place", "us"), F.col("user_map_value.readings").alias("__all"))
    value = [F.col("__all")[F.col("place") * len(reads) + i] for i in range(len(reads))]
    rows = chunks.select("series", "us", *[F.when(~F.isnan(v), v).alias(c) for v, c in zip(value, reads, strict=True)])
    return rows.join(heads, "series").filter("anchor_us IS NULL OR us > anchor_us")


def pending_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(series, pending): how many rows of each series of a stopped stream wait for release."""
    return waiting_readings(spark, checkpoint).groupBy("series").agg(F.count("*").alias("pending"))


def provisional(spark: SparkSession, checkpoint: str, config: SeriesConfig) -> DataFrame:
    """(series, us, value, standard_deviation) of the rows that wait for release, smoothed back from their series' last reading; the stream's state is not changed.

    The waiting readings of a series are filtered again from its anchor, thousands of series in step; no series has more of them than max_window.
    """
    model = WaterBalance(config)
    names = names_of(model)
    waiting = waiting_readings(spark, checkpoint)

    def work(df: pd.DataFrame) -> pd.DataFrame:
        df = df.reset_index(drop=True)
        start, size = groups_of(df, ["series"])
        us = df["us"].to_numpy()
        dt = np.diff(us, prepend=us[:1]) / 1e6
        first = df["anchor_us"].to_numpy(dtype=float)[start]
        dt[start] = np.where(np.isfinite(first), (us[start] - np.nan_to_num(first)) / 1e6, np.nan)
        df = df.assign(dt=dt, first_storage=np.repeat(df["storage"].to_numpy(dtype=float)[start], size), first_outflow=np.repeat(df["outflow"].to_numpy(dtype=float)[start], size))
        m, p = model.initial(df.iloc[start])[0], np.zeros((len(start), 3, 3))
        for g in np.flatnonzero(np.isfinite(first)):
            anchor = np.asarray(df["anchor"].iloc[start[g]], dtype=float)
            m[g], p[g] = anchor[:3], unpacked(anchor[None, 3:])[0]
        bm, bp, m, p, _, _ = filtered_groups(m, p, kernel_inputs(df, model), start, size)
        behind = _with_behind(names, model, df, bm, bp, m, p)
        behind.loc[start + size - 1, [c for c in behind.columns if c.startswith("n_")]] = np.nan
        parts, _ = backward_functions(behind, model)
        sm, sp = swept_groups(parts, np.zeros((len(start), 3)), np.zeros((len(start), 3, 3)), start, size)
        return pd.DataFrame({"value": sm[:, 1], "standard_deviation": np.sqrt(np.maximum(sp[:, 1, 1], 0))}).assign(series=df["series"].to_numpy(), us=us)

    return by_groups(waiting, ["series"], "us", work, f"{doubles(['value', 'standard_deviation'])}, series string, us long").select("series", "us", "value", "standard_deviation")
