"""Unit systems: how a flow over time becomes a volume."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Square feet in an acre, metres in a foot.
SQUARE_FEET_PER_ACRE = 43560.0
METRES_PER_FOOT = 0.3048


@dataclass(frozen=True)
class UnitSystem:
    """Labels of volume and flow, and the volume that a unit of flow adds in one second."""

    volume: str = "acre-ft"
    flow: str = "cfs"
    flow_to_volume_per_second: float = 1.0 / SQUARE_FEET_PER_ACRE

    def __post_init__(self):
        if not (self.volume.strip() and self.flow.strip()):
            raise ValueError("labels must not be empty")
        if not math.isfinite(self.flow_to_volume_per_second) or self.flow_to_volume_per_second <= 0:
            raise ValueError("flow_to_volume_per_second must be positive and finite")

    def volume_of(self, flow: Column, seconds: Column) -> Column:
        """The volume of a flow over some seconds."""
        return flow * seconds * F.lit(self.flow_to_volume_per_second)

    def flow_of(self, volume: Column, seconds: Column) -> Column:
        """The mean flow that moves a volume in some seconds; null unless seconds are positive."""
        return F.when(seconds > 0, volume / (seconds * F.lit(self.flow_to_volume_per_second)))

    def factors_to(self, other: UnitSystem) -> tuple[float, float]:
        """(volume factor, flow factor) into another system; only equal systems, or US and SI, convert."""
        if self == other:
            return 1.0, 1.0
        cubic = METRES_PER_FOOT**3
        if (self, other) == (US, SI):
            return SQUARE_FEET_PER_ACRE * cubic, cubic
        if (self, other) == (SI, US):
            return 1 / (SQUARE_FEET_PER_ACRE * cubic), 1 / cubic
        raise ValueError(f"no conversion from {self.volume}/{self.flow} to {other.volume}/{other.flow}")


SECONDS_PER_HOUR = 3600
US = UnitSystem()
SI = UnitSystem("m3", "m3/s", 1.0)


def valid_flow(flow: Column) -> Column:
    """True for finite values, false for NaN and infinity, null for null."""
    return ~F.isnan(flow) & (F.abs(flow) < F.lit(float("inf")))


def q_of_hourly_sd(sd: float) -> float:
    """The inflow noise per second whose random walk spreads by sd in an hour."""
    if not 0 < sd < math.inf:
        raise ValueError("an hourly deviation must be positive and finite")
    return sd * sd / SECONDS_PER_HOUR


def hourly_sd_of_q(q: str | Column) -> Column:
    """The hourly deviation of a column of noise per second."""
    return F.sqrt(F.col(q) * SECONDS_PER_HOUR if isinstance(q, str) else q * SECONDS_PER_HOUR)
