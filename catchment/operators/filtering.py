"""The water-balance filter and its smoothers: the model of linear.py in which storage gains what flows in and loses what flows out.

The state is storage, inflow and outflow; over dt seconds storage gains c * (inflow - outflow) * dt,
the two flows walk randomly, and readings show storage and outflow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US
from ..plans.config import SeriesConfig
from . import linear
from .linear import Names

NAMES = Names(3, 2)
MEAN, COV = NAMES.mean, NAMES.cov
SMOOTHED_STATE = NAMES.smoothed
#: What each of the two readings shows.
OBSERVED = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])


def transitions(dt: np.ndarray, c: float) -> np.ndarray:
    f = np.broadcast_to(np.eye(3), (len(dt), 3, 3)).copy()
    f[:, 0, 1] = c * dt
    f[:, 0, 2] = -c * dt
    return f


def process_bases(dt: np.ndarray, c: float) -> np.ndarray:
    """(rows, 9, 3, 3): the noise over dt for each entry of q that is one and all others zero; process_covariances is their sum weighted by q."""
    a = np.zeros((3, 3))
    a[0] = 0, c, -c
    d = dt[:, None, None, None]
    unit = np.eye(9).reshape(9, 3, 3)
    return unit * d + (a @ unit + unit @ a.T) * d**2 / 2 + (a @ unit @ a.T) * d**3 / 3


def process_covariances(dt: np.ndarray, q: np.ndarray, c: float) -> np.ndarray:
    """The noise that q adds over dt: the integral of F(s) q F(s)', exact under splitting an interval."""
    a = np.zeros((3, 3))
    a[0] = 0, c, -c
    d = dt[:, None, None]
    return q * d + (a @ q + q @ a.T) * d**2 / 2 + (a @ q @ a.T) * d**3 / 3


@dataclass(frozen=True)
class WaterBalance:
    """The water balance as a linear.Model: step rows (see prepare.steps) have dt and the series' first storage and outflow, from which it starts."""

    config: SeriesConfig
    states = 3
    reads = ("storage", "outflow")
    moves = ("dt",)
    needs = ("dt", "first_storage", "first_outflow")

    @property
    def c(self) -> float:
        return self.config.units.flow_to_volume_per_second

    def transitions(self, rows: pd.DataFrame) -> np.ndarray:
        return transitions(_seconds(rows), self.c)

    def process(self, rows: pd.DataFrame) -> np.ndarray:
        return process_covariances(_seconds(rows), np.asarray(self.config.q), self.c)

    def observation(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.broadcast_to(OBSERVED, (len(rows), 2, 3)), np.broadcast_to(np.asarray(self.config.r), (len(rows), 2, 2))

    def initial(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return start_state(rows["first_storage"].to_numpy(dtype=float), rows["first_outflow"].to_numpy(dtype=float), self.config)


def start_state(storage: np.ndarray, outflow: np.ndarray, config: SeriesConfig) -> tuple[np.ndarray, np.ndarray]:
    """The state before a series' first reading: as much flows in as out."""
    return np.stack([storage, outflow, outflow], axis=1), np.broadcast_to(np.asarray(config.p0), (len(storage), 3, 3)).copy()


def _seconds(rows: pd.DataFrame) -> np.ndarray:
    return np.nan_to_num(rows["dt"].to_numpy(dtype=float))


def filtered(step_rows: DataFrame, config: SeriesConfig, span: int = SPAN_US) -> DataFrame:
    """step_rows with the predicted (b...) and filtered states, innovations and their covariance, and dt.

    Columns bm0..bp22 (before the reading), m0..p22 (after), v0, v1 (innovations, null if not read), s00, s01, s11, log_density.
    """
    return linear.filtered(step_rows, WaterBalance(config), ("first_us", "second_us"), span)


def smoothed(states: DataFrame, config: SeriesConfig, provisional: bool = False, whole: bool = False, span: int = SPAN_US) -> DataFrame:
    """(series, us, sm0..sm2, sp00..sp22, release_us, released) for each filtered row.

    A row is released by the first row at least the lag later, and smoothed back from that one.
    Rows not yet released have nulls, or with provisional are smoothed back from the series' last row; with whole,
    all rows are smoothed back from the last row. See linear.smoothed_by_lag and linear.smoothed_back.
    """
    model = WaterBalance(config)
    if whole:
        return linear.smoothed_back(states, model, span).select("*", F.lit(None).cast("long").alias("release_us"), F.lit(False).alias("released"))
    fixed = linear.smoothed_by_lag(states, model, config.lag_us, span)
    if not provisional:
        return fixed
    last = states.groupBy("series").agg(F.max("us").alias("__last"))
    tail = states.join(last, "series").filter(F.col("us") > F.col("__last") - config.lag_us).drop("__last")
    values = linear.smoothed_back(tail, model, span).select("series", "us", F.struct(*SMOOTHED_STATE).alias("back"))
    joined = fixed.join(values, ["series", "us"], "left")
    return joined.select("series", "us", *[F.when(F.col("released"), F.col(n)).otherwise(F.col(f"back.{n}")).alias(n) for n in SMOOTHED_STATE], "release_us", "released")
