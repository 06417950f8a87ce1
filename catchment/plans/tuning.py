"""Noise settings scored and searched: many candidates are filtered in one Spark job, the search itself keeps a few numbers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, finite
from ..functions.units import hourly_sd_of_q, q_of_hourly_sd
from ..operators.filtering import filtered
from ..operators.prepare import checked_order, in_windows, steps
from ..operators.reading_noise import POOLED, ProxySettings, proxy_check, reading_noise, reading_noise_warnings
from ..operators.scores import autocorrelation_metrics, calibration_warnings, pooled_metrics, row_scores, scored_rows, validity, window_scores
from ..sources.shared import staged
from .candidates import Candidate, candidate_sums, objective, of_config, windowed_steps
from .config import ScoreSettings, SeriesConfig, Window, checked_windows
from .search import minimize

TERMS = ("q_storage", "q_inflow", "q_outflow", "r_storage", "r_outflow")


#: Candidates scored in one job.
BATCH = 64
#: Warnings of a kind that a tuning spells out; its tables have them all.
LISTED = 100


class TuningError(RuntimeError):
    """No candidate could be used."""


@dataclass(frozen=True)
class TuningSettings:
    """Bounds of each term as multiples of the base, and the search's budget. The default bounds, factor and step."""

    bounds: dict = field(default_factory=lambda: {"q_storage": (0.5, 1.0), "q_inflow": (0.001, 10.0), "q_outflow": (0.1, 10.0), "r_storage": (0.5, 1.0), "r_outflow": (0.01, 4.0)}, hash=False)
    estimate_r_storage: bool = True
    r_storage_factor: float = 2.0
    evaluations: int = 200
    local_searches: int = 2
    hessian_step: float = 0.05
    check_identifiability: bool = True

    def __post_init__(self):
        if set(self.bounds) != set(TERMS) or any(not 0 < a < b or not math.isfinite(b) for a, b in self.bounds.values()):
            raise ValueError("every term needs bounds 0 < low < high")
        if self.r_storage_factor <= 1 or self.evaluations < 1 or self.local_searches < 1:
            raise ValueError("settings out of range")


def windows_frame(like: DataFrame, windows: list[Window]) -> DataFrame:
    """(series, name, start_us, end_us, weight) of the windows for every series of like."""
    each = F.array(*[F.struct(F.lit(w.name).alias("name"), F.lit(w.start_us).cast("long").alias("start_us"), F.lit(w.end_us).cast("long").alias("end_us"), F.lit(float(w.weight)).alias("weight")) for w in checked_windows(windows)])
    return like.select("series").distinct().select("series", F.explode(each).alias("w")).select("series", "w.*")


def candidate_scores(step_rows: DataFrame, config: SeriesConfig, candidates: list[Candidate], span: int = SPAN_US) -> DataFrame:
    """row_scores for every candidate: (candidate, series, us, ...).

    For a few candidates whose rows are wanted; candidate_sums scores many at once.
    """
    out = None
    for k, c in enumerate(candidates):
        one = row_scores(filtered(step_rows, c.config(config), span)).withColumn("candidate", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(obs: DataFrame, config: SeriesConfig, windows: list[Window] | None = None, settings: ScoreSettings | None = None, span: int = SPAN_US) -> dict[str, DataFrame]:
    """A frozen configuration's scores: windows, pooled metrics, validity and warnings.

    Without windows, one holds all times. Series without two storage readings have no scores.
    """
    settings = settings or ScoreSettings()
    if windows is None:
        low, high = obs.agg(F.min("us"), F.max("us")).first()
        windows = [Window("all-data", low or 0, (high or 0) + 1)]
    frame = windows_frame(obs, windows)
    scores = staged(row_scores(filtered(staged(steps(checked_order(obs), span=span), "steps"), config, span)), "scores")
    rows = window_scores(scores, frame, settings)
    pooled = staged(pooled_metrics(scores, frame, settings, span).join(autocorrelation_metrics(scores, frame, settings, span), "series", "left"), "pooled")
    return {"rows": scored_rows(scores, int(settings.warmup.total_seconds() * 1e6)), "windows": rows, "pooled": pooled, "validity": validity(rows, settings), "warnings": calibration_warnings(pooled, settings)}


class Search:
    """The objective of points in the unit cube of logarithmic bounds, kept once computed; points are scored in batches, one job each."""

    def __init__(self, step_rows: DataFrame, base: SeriesConfig, windows: DataFrame, settings: ScoreSettings, bounds: dict, progress: Callable[[str, int], None] | None = None, span: int = SPAN_US):
        self.step_rows, self.base, self.windows, self.settings, self.progress = step_rows, base, windows, settings, progress
        self.rows, self.single = windowed_steps(step_rows, windows, settings, span)
        self.low = np.log([bounds[t][0] for t in TERMS])
        self.high = np.log([bounds[t][1] for t in TERMS])
        self.known: dict[tuple, float] = {}
        self.totals: dict[tuple, float] = {}
        self.reasons: dict[tuple, list] = {}
        self.passes = 0

    def candidate(self, x) -> Candidate:
        return Candidate(tuple(np.exp(self.low + np.clip(x, 0, 1) * (self.high - self.low)).tolist()))

    def point(self, c: Candidate) -> np.ndarray:
        return np.clip((np.log(c.values) - self.low) / (self.high - self.low), 0, 1)

    def values(self, candidates: list[Candidate], phase: str) -> np.ndarray:
        """The objectives, infinite for candidates that can't be used. Several series count by their mean."""
        new = [c for c in dict.fromkeys(candidates) if c.values not in self.known]
        for part in [new[i : i + BATCH] for i in range(0, len(new), BATCH)]:
            sums = candidate_sums(self.rows, self.single, self.base, part)
            rows = objective(sums, len(part), self.windows, self.settings).groupBy("candidate").agg(F.avg("objective").alias("mean"), F.sum("total").alias("total"), F.count_if(F.col("objective").isNull()).alias("bad"), F.count_if(F.col("total").isNull()).alias("lost"), F.first("reasons").alias("reasons")).collect()
            for r in rows:
                self.known[part[r.candidate].values] = math.inf if r.bad or r["mean"] is None else r["mean"]
                self.totals[part[r.candidate].values] = math.inf if r.lost or r.total is None else r.total
                self.reasons[part[r.candidate].values] = list(r.reasons)
            self.passes += len(part)
            if self.progress:
                self.progress(phase, self.passes)
        return np.array([self.known.get(c.values, math.inf) for c in candidates])

    def local(self, start: np.ndarray, evaluations: int) -> np.ndarray:
        """Where the quasi-Newton search from start ends (see search.minimize)."""
        return minimize(lambda points: self.values([self.candidate(x) for x in points], "search"), start, evaluations)[0]


def identifiability(search: Search, chosen: Candidate, step: float) -> dict:
    """Standard errors and correlations of the logarithms of the terms not at a bound, by a central-difference Hessian of 2 n squared + 1 points.

    The Hessian is that of the whole negative log density of all scored readings, so window weights don't enter, and series with too few readings in a window count with those they have.
    """
    x = search.point(chosen)
    free = [i for i in range(len(TERMS)) if 1e-6 < x[i] < 1 - 1e-6]
    if not free:
        return {"free": [], "standard_errors": {}, "correlations": {}, "warnings": ["every term is at a bound"]}
    base = np.log(chosen.values)
    shifts: dict[tuple, Candidate] = {}
    for a, i in enumerate(free):
        for b in range(a, len(free)):
            for s in (-1, 1):
                for t in (-1, 1):
                    d = np.zeros(len(base))
                    d[i] += s * step / (2 if a == b else 1)
                    d[free[b]] += t * step / (2 if a == b else 1)
                    shifts[a, b, s, t] = Candidate(tuple(np.exp(base + d).tolist()))
    keys = list(shifts)
    search.values([shifts[k] for k in keys], "identifiability")
    found = {k: search.totals.get(shifts[k].values, math.inf) for k in keys}
    h = np.zeros((len(free), len(free)))
    for a in range(len(free)):
        for b in range(a, len(free)):
            value = found[a, b, 1, 1] - found[a, b, 1, -1] - found[a, b, -1, 1] + found[a, b, -1, -1]
            h[a, b] = h[b, a] = value / (step**2 if a == b else 4 * step**2)
    names = [TERMS[i] for i in free]
    if not np.isfinite(h).all() or np.linalg.eigvalsh(h)[0] <= 0:
        # Correlations need all terms' curvature; a term's own curvature still bounds how well it is determined.
        own = np.diag(h)
        errors = {t: 1 / math.sqrt(v) if v > 0 else math.inf for t, v in zip(names, own, strict=True) if math.isfinite(v)}
        blind = [f"{t} couldn't be checked: a point beside it can't be used" for t, v in zip(names, own, strict=True) if not math.isfinite(v)]
        return {"free": names, "standard_errors": errors, "correlations": {}, "warnings": ["the objective is not curved in every direction, so terms may hide one another", *blind, *_loose(errors)]}
    cov = np.linalg.inv(h)
    se = np.sqrt(np.diag(cov))
    corr = cov / np.outer(se, se)
    pairs = {(names[a], names[b]): float(corr[a, b]) for a in range(len(free)) for b in range(a + 1, len(free))}
    errors = dict(zip(names, se.tolist(), strict=True))
    warnings = [f"{a} and {b} can't be told apart" for (a, b), v in pairs.items() if abs(v) > 0.95] + _loose(errors)
    return {"free": names, "standard_errors": errors, "correlations": {f"{a}/{b}": v for (a, b), v in pairs.items()}, "warnings": warnings}


def _loose(errors: dict[str, float]) -> list[str]:
    """Warnings of the terms whose logarithm is uncertain by more than one."""
    return [f"{t} is loosely determined" for t, v in errors.items() if not v <= 1]


def standard_error(values: np.ndarray, weights: np.ndarray) -> float:
    """Of a weighted mean over windows, by the unbiased weighted variance; zero for a single window."""
    w = np.asarray(weights, dtype=float) / np.sum(weights)
    free = 1 - float(w @ w)
    if free <= 0:
        return 0.0
    mean = float(w @ values)
    return math.sqrt(max(0.0, float(w @ (values - mean) ** 2) / free * float(w @ w)))


def paired_gains(rows: DataFrame) -> DataFrame:
    """(series, gain, error, windows) of rows(series, name, gain, weight): the weighted mean over a series' windows and its standard error, as standard_error gives it; for any number of series."""
    shares = rows.groupBy("series").agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("gain")).alias("sum"))
    each = rows.join(shares, "series").withColumns({"w": F.col("weight") / F.col("total"), "off": F.col("gain") - F.col("sum") / F.col("total")})
    found = each.groupBy("series").agg(F.sum(F.col("w") * F.col("gain")).alias("gain"), F.sum(F.col("w") * F.col("w")).alias("own"), F.sum(F.col("w") * F.col("off") * F.col("off")).alias("spread"), F.count("*").alias("windows"))
    return found.select("series", "gain", F.when(F.col("own") < 1, F.sqrt(F.col("spread") / (1 - F.col("own")) * F.col("own"))).otherwise(0.0).alias("error"), "windows")


def paired_error(differences: np.ndarray, weights: np.ndarray, settings: ScoreSettings) -> float:
    """Standard error of a weighted mean difference: by a seeded bootstrap from five windows on, else analytic."""
    if len(differences) < 5 or settings.bootstrap_samples < 2:
        return standard_error(differences, weights)
    picks = np.random.default_rng(settings.seed).choice(len(differences), size=(settings.bootstrap_samples, len(differences)))
    means = (differences[picks] * weights[picks]).sum(axis=1) / weights[picks].sum(axis=1)
    return float(np.std(means, ddof=1))


def starting_points(base: np.ndarray, seeds: list[float] | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[np.ndarray]:
    """The base and four others: the cube's middle, inflow noise low and high, and reading noise low; or one for each hourly inflow deviation of seeds."""
    middle = np.full(len(base), 0.5)
    if seeds:
        out = [base]
        for sd in seeds:
            x = middle.copy()
            x[1] = np.clip((math.log(q_of_hourly_sd(sd)) - low[1]) / (high[1] - low[1]), 0, 1)
            out.append(x)
        return out
    small, large, still = middle.copy(), middle.copy(), middle.copy()
    small[1], large[1], still[3:] = 0.15, 0.85, 0.15
    return [base, middle, small, large, still]


def _compared(search: Search, base: Candidate, chosen: Candidate) -> tuple[DataFrame, float | None, float | None]:
    """(window frame of both, weighted gain of chosen over base per component, its paired standard error); no gain if the base can't be used."""
    scores = candidate_scores(search.step_rows, search.base, [base, chosen])
    rows = staged(window_scores(scores, search.windows, search.settings, ("candidate",)).join(search.windows.select("series", "name", "weight"), ["series", "name"]), "windows")
    frame = rows.select(F.when(F.col("candidate") == 0, "base").otherwise("selected").alias("role"), *[c for c in rows.columns if c not in ("candidate", "weight", "unscorable_count")])
    if not math.isfinite(search.known.get(base.values, math.inf)):
        return frame, None, None
    # One row a window, whatever the number of series.
    means = rows.groupBy("name", "candidate").agg(F.avg("joint_nlpd").alias("loss"), F.avg("weight").alias("weight"))
    pairs = means.filter("candidate = 0").alias("a").join(means.filter("candidate = 1").alias("b"), "name").select("name", (F.col("a.loss") - F.col("b.loss")).alias("gain"), "a.weight").orderBy("name").collect()
    gains, weights = np.array([r.gain for r in pairs], dtype=float), np.array([r.weight for r in pairs], dtype=float)
    if not len(gains) or not np.isfinite(gains).all():
        return frame, None, None
    return frame, float(weights @ gains), paired_error(gains, weights, search.settings)


def proxy_frame(search: Search, candidates: dict[str, Candidate], proxy: DataFrame, settings: ProxySettings | None = None) -> DataFrame:
    """proxy_check of each candidate's causal inflow against proxy(series, us, proxy), over the scored rows of the windows only."""
    out = None
    for name, c in candidates.items():
        scores = row_scores(filtered(search.step_rows, c.config(search.base)))
        rows = in_windows(scored_rows(scores, int(search.settings.warmup.total_seconds() * 1e6)), search.windows).select("series", "us", F.col("m1").alias("estimate"))
        both = rows.join(proxy.select("series", "us", finite("proxy").alias("proxy")), ["series", "us"], "full")
        one = proxy_check(both, settings).withColumn("candidate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return staged(out, "proxies")


def tune(obs: DataFrame, base: SeriesConfig, windows: list[Window], settings: ScoreSettings | None = None, tuning: TuningSettings | None = None, progress: Callable[[str, int], None] | None = None, proxy: DataFrame | None = None, seeds: list[float] | None = None, version: str | None = None) -> dict:
    """The noise setting with the least weighted joint density over three windows or more.

    Starting points (one for each hourly inflow deviation of seeds, if given) are scored in one job, the best are refined, and the least
    objective wins, an optimum before the base of equal ones. Returns the proposed configuration, the objectives, the gain over the base
    with its paired error, identifiability, the frames of candidates, windows, reading noise and, with proxy(series, us, proxy), of the proxy
    check, and all warnings, which never change the selection. Nothing is stored. progress(phase, passes) may raise to stop.
    obs is read many times: it should be a table, not a long computation.
    """
    settings, tuning = settings or ScoreSettings(), tuning or TuningSettings()
    if len(windows) < 3:
        raise ValueError("tuning needs three windows or more")
    version = version or f"{base.version}-tuned"
    if version == base.version:
        raise ValueError("the proposal needs a version of its own")
    base_c = of_config(base)
    bounds = {t: (v * tuning.bounds[t][0], v * tuning.bounds[t][1]) for t, v in zip(TERMS, base_c.values, strict=True)}
    frame = staged(windows_frame(obs, windows), "frame")
    noise, measured = None, None
    if tuning.estimate_r_storage:
        noise = staged(reading_noise(obs, frame.select("series", "name", "start_us", "end_us")), "noise")
        measured = noise.filter(F.col("window") == POOLED).agg(F.median("r_storage")).first()[0]
        if measured:
            bounds["r_storage"] = (measured / tuning.r_storage_factor, measured * tuning.r_storage_factor)
    search = Search(staged(steps(checked_order(obs)), "steps"), base, frame, settings, bounds, progress)
    starts = starting_points(search.point(base_c), seeds, search.low, search.high)
    found = search.values([search.candidate(x) for x in starts] + [base_c], "screening")
    best = [starts[i] for i in np.argsort(found[:-1], kind="stable")[: tuning.local_searches] if math.isfinite(found[i])]
    ends = [search.candidate(search.local(x, tuning.evaluations)) for x in best]
    values = search.values([*ends, base_c], "selection")
    if not np.isfinite(values).any():
        raise TuningError("; ".join(sorted({r for x in search.reasons.values() for r in x})) or "no candidate could be used")
    k = int(np.argmin(values))
    kept, chosen = k == len(ends), [*ends, base_c][k]
    identified = identifiability(search, chosen, tuning.hessian_step) if tuning.check_identifiability else None
    tables = evaluate(obs, chosen.config(base), windows, settings)
    x = search.point(chosen)
    at_bound = [] if kept else [t for t, v in zip(TERMS, x, strict=True) if v < 1e-6 or v > 1 - 1e-6]
    pair_frame, gain, error = _compared(search, base_c, chosen)
    proxies = proxy_frame(search, {"base": base_c} | {f"search-{i + 1}": c for i, c in enumerate(ends)}, proxy) if proxy is not None else None
    name = "base" if kept else f"search-{k + 1}"
    warnings = _gain_warnings(kept, gain, error) + [f"the search ended at the bounds of {', '.join(at_bound)}"] * bool(at_bound) + ["with fewer than five windows, errors are weak"] * (len(windows) < 5)
    warnings += _listed(tables["warnings"].select("series", F.format_string("calibration of %s: %s is %s", "series", "metric", F.col("value").cast("string"))), "calibration warnings")
    warnings += identified["warnings"] if identified else []
    if noise is not None:
        found_noise = reading_noise_warnings(noise)
        tables["reading_noise_warnings"] = found_noise
        warnings += _listed(found_noise.select("series", F.concat(F.lit("reading noise of "), F.col("series"), F.lit(": "), F.col(found_noise.columns[-1]))), "reading noise warnings")
    if proxies is not None and not proxies.filter((F.col("candidate") == name) & ~F.col("proxy_check_passed")).isEmpty():
        warnings.append("the selected setting doesn't follow the proxy's shape or timing")
    selection = {"candidate": name, "objective": float(values[k]), "base_objective": float(values[-1]), "gain_error": error, "measured_r_storage": measured}
    proposed = replace(chosen.config(base), version=version, metadata=dict(base.metadata) | {"tuned_from": base.version, "selection": selection})
    candidates = obs.sparkSession.createDataFrame([(*v, None if math.isinf(o) else float(o), v == chosen.values, "; ".join(search.reasons.get(v, []))) for v, o in search.known.items()], ", ".join(f"{t} double" for t in TERMS) + ", objective double, selected boolean, reasons string").withColumn("inflow_increment_sd", hourly_sd_of_q("q_inflow"))
    return {"config": proposed, "objective": float(values[k]), "base_objective": float(values[-1]), "improved": bool(values[k] < values[-1]), "improvement": gain, "improvement_error": error, "at_bound": at_bound, "measured_r_storage": measured, "identifiability": identified, "candidates": candidates, "compared_windows": pair_frame, "reading_noise": noise, "proxies": proxies, "selection_warnings": list(dict.fromkeys(warnings)), "passes": search.passes, **tables}


def _listed(rows: DataFrame, kind: str, most: int = LISTED) -> list[str]:
    """The texts of rows(series, text) in order; beyond `most` of them a line that says how many more the table of their kind has."""
    total = rows.count()
    text = rows.columns[1]
    first = [r[1] for r in rows.orderBy("series", text).limit(most).collect()]
    return first + [f"{total - most} more {kind} in their table"] * (total > most)


def _gain_warnings(kept: bool, gain: float | None, error: float | None) -> list[str]:
    if kept:
        return ["no search did better than the base, which is kept"]
    if gain is None:
        return ["the base couldn't be scored, so the gain over it is unknown"]
    return [] if gain > error else [f"the gain over the base, {gain:.4g}, is within its error of {error:.4g}"]
