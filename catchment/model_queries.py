"""Registered queries of models other than the water balance, of stopped streams, and of frozen and tuned configurations, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import oracle, queries
from .functions.columns import micros
from .functions.units import SI, US
from .operators import estimate, linear, prepare, reading_noise, scores
from .plans import candidates, tuning
from .plans.config import Window as Span
from .queries import CONFIG, DAY_US, SETTINGS, START_US, _rounded, event_observations, streamed
from .sources.shared import staged
from .streaming import inflow

DAY = 86_400.0
#: Level and trend: noise a day, reading noise, and the state before the first reading.
LEVEL_Q, LEVEL_R, LEVEL_MEAN, LEVEL_P0 = (4.0, 0.25), 9.0, (50.0, 0.0), (400.0, 25.0)
HALF_US = START_US + 15 * DAY_US
#: Step of the logarithms of the terms for second differences.
HESSE = 0.05


def _levels(spark, sf_dir) -> DataFrame:
    """(series, us, reading): the events' values by user, the last of a time; errors have no reading."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("series"), micros("ts").alias("us"), "event_type", "value")
    one = prepare.keep_last(e, ["series", "us"], ["event_id"])
    return one.select("series", "us", F.when(F.col("event_type") != "error", F.col("value")).alias("reading"))


def _with_matrices(rows: DataFrame, reads: tuple[str, ...] = ("reading",)) -> DataFrame:
    """Step rows of the level and trend model: F and Q of the days since the row before, as arrays."""
    steps = linear.model_steps(rows, linear.Given(reads, "f", "q", [[1.0, 0.0]] * len(reads), [[0.0] * len(reads)] * len(reads), LEVEL_MEAN, [[LEVEL_P0[0], 0], [0, LEVEL_P0[1]]]))
    d = F.col("dt") / DAY
    zero, one = F.lit(0.0), F.lit(1.0)
    return steps.withColumns({"f": F.when(d.isNotNull(), F.array(one, d, zero, one)), "q": F.when(d.isNotNull(), F.array(LEVEL_Q[0] * d, zero, zero, LEVEL_Q[1] * d))})


def _level_model(r: float = LEVEL_R) -> linear.Given:
    return linear.Given(("reading",), "f", "q", [[1.0, 0.0]], [[r]], LEVEL_MEAN, [[LEVEL_P0[0], 0], [0, LEVEL_P0[1]]])


def level_and_trend(spark, sf_dir):
    """A model of two states, its F and Q given as array columns: level and trend of each user's values, and the readings' log density."""
    out = linear.filtered(_with_matrices(_levels(spark, sf_dir)), _level_model(), span=7 * DAY_US)
    return _rounded(out.select("series", "us", F.col("m0").alias("level"), F.col("m1").alias("trend"), F.sqrt("p00").alias("deviation"), "log_density"), "level", "trend", "deviation", "log_density", digits=5)


def level_smoothed(spark, sf_dir):
    """The same model smoothed back from each user's last row, and with a lag of three days."""
    model = _level_model()
    states = staged(linear.filtered(_with_matrices(_levels(spark, sf_dir)), model), "states")
    whole = linear.smoothed_back(states, model, 7 * DAY_US).select("series", "us", F.col("sm0").alias("smoothed"), F.sqrt("sp00").alias("deviation"))
    fixed = linear.smoothed_by_lag(states, model, 3 * DAY_US, 7 * DAY_US).select("series", "us", F.col("sm0").alias("revised"), "release_us")
    return _rounded(whole.join(fixed, ["series", "us"]), "smoothed", "deviation", "revised", digits=5)


def twin_readings(spark, sf_dir):
    """Two readings without noise that show the same level: every innovation covariance is singular, and each row is solved by itself."""
    rows = _levels(spark, sf_dir).select("series", "us", F.col("reading").alias("one"), F.col("reading").alias("other"))
    model = linear.Given(("one", "other"), "f", "q", [[1.0, 0.0], [1.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]], LEVEL_MEAN, [[LEVEL_P0[0], 0], [0, LEVEL_P0[1]]])
    out = linear.filtered(_with_matrices(rows, ("one", "other")), model, span=7 * DAY_US)
    return _rounded(out.select("series", "us", F.col("m0").alias("level"), F.col("m1").alias("trend"), F.col("p11").alias("trend_variance")), "level", "trend", "trend_variance", digits=5)


def matrix_faults(spark, sf_dir):
    """Arrays that don't fit a model, made out of the events' numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id"), F.col("user_id").cast("string").alias("series"), micros("ts").alias("us"), F.lit(1.0).alias("dt"))
    k, one, zero = F.col("event_id") % 10, F.lit(1.0), F.lit(0.0)
    f = F.when(k == 0, F.array(one, one, zero)).when(k == 1, F.array(one, F.lit(float("inf")), zero, one)).when(k != 2, F.array(one, one, zero, one))
    q = F.when(k == 3, F.array(one, F.lit(0.5), F.lit(0.25), one)).when(k == 4, F.array(one, F.lit(2.0), F.lit(2.0), one)).when(k == 5, F.array(one, F.lit(float("nan")), zero, one)).otherwise(F.array(one, F.lit(0.5), F.lit(0.5), one))
    return linear.matrix_faults(e.select("event_id", "series", "us", "dt", f.alias("f"), q.alias("q")), _level_model()).select("series", "us", "matrix", "fault")


def infinite_readings(spark, sf_dir):
    """Readings that are infinite: every eleventh event's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    high = F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = e.select(F.col("user_id").cast("string").alias("series"), micros("ts").alias("us"), F.col("value").alias("storage"), high.alias("outflow"))
    return linear.infinite_readings(rows, ("storage", "outflow"))


def stream_provisional(spark, sf_dir):
    """A stream that is stopped half-way: its rows that wait for release, smoothed back from the last readings out of the stored state."""
    _, check = streamed(spark, [event_observations(spark, sf_dir).filter(F.col("us") < HALF_US)])
    return _rounded(inflow.provisional(spark, check, CONFIG), "value", "standard_deviation", digits=4)


def stream_pending(spark, sf_dir):
    """How many rows of each series wait in the state of that stream."""
    _, check = streamed(spark, [event_observations(spark, sf_dir).filter(F.col("us") < HALF_US)])
    return inflow.pending_counts(spark, check)


QUERIES = {f.__name__: f for f in (level_and_trend, level_smoothed, twin_readings, matrix_faults, infinite_readings, stream_provisional, stream_pending)}

_D = "CAST(86400 AS DOUBLE)"
_LEVELS = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, event_type, value, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events),
steps AS (SELECT series, us, CASE WHEN event_type <> 'error' THEN value END AS y, (us - lag(us) OVER w) / 1e6 / {_D} AS d, row_number() OVER w AS n FROM e WHERE rn = 1 WINDOW w AS (PARTITION BY series ORDER BY us))"""


def _level_update(source: str, r: float) -> str:
    """SQL that adds the state after the reading to rows with b0, b1, q00, q01, q11 (before it) and y."""
    gain = f"SELECT *, CASE WHEN y IS NULL THEN CAST(0 AS DOUBLE) ELSE q00 / (q00 + {r}) END AS k0, CASE WHEN y IS NULL THEN CAST(0 AS DOUBLE) ELSE q01 / (q00 + {r}) END AS k1, coalesce(y - b0, 0) AS v FROM ({source})"
    return f"""SELECT series, us, n, y, d, b0, b1, q00, q01, q11, b0 + k0 * v AS m0, b1 + k1 * v AS m1, (1 - k0) * q00 AS p00, (1 - k0) * q01 AS p01, q11 - k1 * q01 AS p11,
  CASE WHEN y IS NULL THEN CAST(0 AS DOUBLE) ELSE -0.5 * (ln(2 * pi()) + ln(q00 + {r}) + v * v / (q00 + {r})) END AS log_density FROM ({gain})"""


def _level_filter(r: float) -> str:
    start = f"SELECT series, us, n, y, CAST(0 AS DOUBLE) AS d, CAST({LEVEL_MEAN[0]} AS DOUBLE) AS b0, CAST({LEVEL_MEAN[1]} AS DOUBLE) AS b1, CAST({LEVEL_P0[0]} AS DOUBLE) AS q00, CAST(0 AS DOUBLE) AS q01, CAST({LEVEL_P0[1]} AS DOUBLE) AS q11 FROM steps WHERE n = 1"
    move = f"SELECT t.series, t.us, t.n, t.y, t.d, m0 + t.d * m1 AS b0, m1 AS b1, p00 + 2 * t.d * p01 + t.d * t.d * p11 + CAST({LEVEL_Q[0]} AS DOUBLE) * t.d AS q00, p01 + t.d * p11 AS q01, p11 + CAST({LEVEL_Q[1]} AS DOUBLE) * t.d AS q11 FROM rec JOIN steps t ON t.series = rec.series AND t.n = rec.n + 1"
    return f"{_LEVELS}, rec AS ({_level_update(start, r)} UNION ALL {_level_update(move, r)})"


# G = P F' (P of the row behind, before its reading)^-1, and the step back with it.
_LEVEL_GAINS = """ahead AS (SELECT *, lead(b0) OVER w AS nb0, lead(b1) OVER w AS nb1, lead(q00) OVER w AS n00, lead(q01) OVER w AS n01, lead(q11) OVER w AS n11, lead(d) OVER w AS nd FROM rec WINDOW w AS (PARTITION BY series ORDER BY n)),
mid AS (SELECT *, p00 + nd * p01 AS c00, p01 AS c01, p01 + nd * p11 AS c10, p11 AS c11, n00 * n11 - n01 * n01 AS det FROM ahead WHERE nd IS NOT NULL),
gains AS (SELECT *, (c00 * n11 - c01 * n01) / det AS g00, (c01 * n00 - c00 * n01) / det AS g01, (c10 * n11 - c11 * n01) / det AS g10, (c11 * n00 - c10 * n01) / det AS g11 FROM mid)"""
_BACK = """t.m0 + t.g00 * (x.s0 - t.nb0) + t.g01 * (x.s1 - t.nb1) AS s0, t.m1 + t.g10 * (x.s0 - t.nb0) + t.g11 * (x.s1 - t.nb1) AS s1,
  t.p00 + t.g00 * t.g00 * (x.v00 - t.n00) + 2 * t.g00 * t.g01 * (x.v01 - t.n01) + t.g01 * t.g01 * (x.v11 - t.n11) AS v00,
  t.p01 + t.g00 * t.g10 * (x.v00 - t.n00) + (t.g00 * t.g11 + t.g01 * t.g10) * (x.v01 - t.n01) + t.g01 * t.g11 * (x.v11 - t.n11) AS v01,
  t.p11 + t.g10 * t.g10 * (x.v00 - t.n00) + 2 * t.g10 * t.g11 * (x.v01 - t.n01) + t.g11 * t.g11 * (x.v11 - t.n11) AS v11"""
_HALF = oracle.filter_sql(queries.Q, queries.R, queries.P0, queries.FACTOR).replace("FROM e WHERE rn = 1", f"FROM e WHERE rn = 1 AND us < {HALF_US}")
_HALF_DONE = f"""{oracle.whole_sql(_HALF, queries.FACTOR)}, waits AS (SELECT series, us, n FROM rec x WHERE us > (SELECT max(us) - {CONFIG.lag_us} FROM rec y WHERE y.series = x.series))"""

ORACLE_SQL = {
    "level_and_trend": f"WITH RECURSIVE {_level_filter(LEVEL_R)} SELECT series, us, round(m0, 5) AS level, round(m1, 5) AS trend, round(sqrt(p00), 5) AS deviation, round(log_density, 5) AS log_density FROM rec",
    "level_smoothed": f"""WITH RECURSIVE {_level_filter(LEVEL_R)}, {_LEVEL_GAINS},
whole AS (SELECT series, n, m0 AS s0, m1 AS s1, p00 AS v00, p01 AS v01, p11 AS v11 FROM rec WHERE (series, n) IN (SELECT series, max(n) FROM rec GROUP BY series)
  UNION ALL SELECT t.series, t.n, {_BACK} FROM whole x JOIN gains t ON t.series = x.series AND t.n = x.n - 1),
release AS (SELECT a.series, a.n AS k, min(b.n) AS at FROM rec a JOIN rec b ON a.series = b.series AND b.us >= a.us + {3 * DAY_US} GROUP BY a.series, a.n),
fixed AS (SELECT r.series, r.k, r.at AS j, r.at, z.m0 AS s0, z.m1 AS s1, z.p00 AS v00, z.p01 AS v01, z.p11 AS v11 FROM release r JOIN rec z ON z.series = r.series AND z.n = r.at
  UNION ALL SELECT x.series, x.k, t.n AS j, x.at, {_BACK} FROM fixed x JOIN gains t ON t.series = x.series AND t.n = x.j - 1 WHERE x.j > x.k)
SELECT rec.series, rec.us, round(w.s0, 5) AS smoothed, round(sqrt(w.v00), 5) AS deviation, round(f.s0, 5) AS revised, z.us AS release_us FROM rec JOIN whole w USING (series, n)
LEFT JOIN (SELECT * FROM fixed WHERE j = k) f ON f.series = rec.series AND f.k = rec.n LEFT JOIN rec z ON z.series = f.series AND z.n = f.at""",
    "twin_readings": f"WITH RECURSIVE {_level_filter(0.0)} SELECT series, us, round(m0, 5) AS level, round(m1, 5) AS trend, round(p11, 5) AS trend_variance FROM rec",
    "matrix_faults": """SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, CASE WHEN event_id % 10 < 3 THEN 'f' ELSE 'q' END AS matrix,
  CASE event_id % 10 WHEN 0 THEN 'size' WHEN 1 THEN 'not finite' WHEN 2 THEN 'missing' WHEN 3 THEN 'not symmetric' WHEN 4 THEN 'negative variance' ELSE 'not finite' END AS fault FROM events WHERE event_id % 10 < 6""",
    "infinite_readings": "SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, 'outflow' AS reading FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0",
    "stream_provisional": f"WITH RECURSIVE {_HALF_DONE} SELECT waits.series, waits.us, round(s1, 4) AS value, round(sqrt(v11), 4) AS standard_deviation FROM waits JOIN whole USING (series, n)",
    "stream_pending": f"WITH RECURSIVE {_HALF_DONE} SELECT series, count(*) AS pending FROM waits GROUP BY series",
}


def _hourly(spark, sf_dir) -> DataFrame:
    """(series, us, value): hourly sums of the events' values, of all and of the users modulo two; mostly without a gap."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = (F.floor(micros("ts") / 3_600_000_000) * 3_600_000_000).cast("long")
    each = e.select(F.explode(F.array(F.lit("all"), (F.col("user_id") % 2).cast("string"))).alias("series"), us.alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return each.groupBy("series", "us").agg((F.sum("cents") / 100).alias("value"))


def even_autocorrelation(spark, sf_dir):
    """Autocorrelation of evenly spaced series by Fourier transforms of spans of five days, of those with gaps by pairs."""
    rows = _hourly(spark, sf_dir)
    return _rounded(scores.autocorrelation(rows, "value", scores.cadence_lags(rows, 2 * DAY_US), span=5 * DAY_US), "autocorrelation", digits=5)


def _hourly_readings(spark, sf_dir) -> DataFrame:
    """Hourly observations, a series per event type: storage out of the hour's sum, outflow its number of events; storage is missing each seventh hour, outflow each eleventh.

    Written once: scoring and tuning read them many times, and would read and sum up all events each time.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(micros("ts") / 3_600_000_000).cast("long")
    sums = e.groupBy(F.col("event_type").alias("series"), hour.alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    late = F.row_number().over(Window.partitionBy("series").orderBy("hour")) > 2
    storage = F.when(~(late & (F.col("hour") % 7 == 0)), 1000 + F.col("cents") / 1000)
    outflow = F.when(~(late & (F.col("hour") % 11 == 0)), F.col("n").cast("double"))
    return staged(sums.select("series", (F.col("hour") * 3_600_000_000).alias("us"), storage.alias("storage"), outflow.alias("outflow")), "readings")


def _frozen(spark, sf_dir) -> dict:
    spans = [Span(f"w{i}", START_US + 10 * i * DAY_US, START_US + 10 * (i + 1) * DAY_US) for i in range(3)]
    return tuning.evaluate(_hourly_readings(spark, sf_dir), CONFIG, spans, SETTINGS)


def frozen_evaluation(spark, sf_dir):
    """A frozen configuration scored over three windows of hourly readings: the pooled metrics with the largest autocorrelations of the deviations."""
    out = _frozen(spark, sf_dir)["pooled"]
    return _rounded(out, *[c for c in out.columns if c != "series"], digits=4).drop("inflow_change_median_per_second", "inflow_change_q95_per_second")


def frozen_windows(spark, sf_dir):
    """The same evaluation by window."""
    return _rounded(_frozen(spark, sf_dir)["windows"].drop("unscorable_count"), *queries.WINDOW_METRICS, digits=5)


def frozen_warnings(spark, sf_dir):
    """Its calibration warnings, that of the autocorrelation among them."""
    return _rounded(_frozen(spark, sf_dir)["warnings"], "value", "low", "high", digits=4)


def identifiability(spark, sf_dir):
    """How well the readings determine two terms of a setting, from the curvature of their log density on a grid of nine points."""
    obs = event_observations(spark, sf_dir)
    base = tuning.of_config(CONFIG)
    bounds = {t: (v, 4 * v) for t, v in zip(tuning.TERMS, base.values, strict=True)} | {t: (v / 4, 4 * v) for t, v in zip(tuning.TERMS, base.values, strict=True) if t in ("r_storage", "r_outflow")}
    search = tuning.Search(staged(prepare.steps(obs), "steps"), CONFIG, queries._three(obs), SETTINGS, bounds)
    found = tuning.identifiability(search, base, HESSE)
    rows = [(t, e, found["correlations"]["r_storage/r_outflow"]) for t, e in found["standard_errors"].items()]
    return _rounded(spark.createDataFrame(rows, "term string, standard_error double, correlation double"), "standard_error", "correlation", digits=4)


def reading_noise_alerts(spark, sf_dir):
    """Warnings of the reading noise of series that give them: too few pairs, changes that don't cancel, windows that differ."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(micros("ts") / 3_600_000_000).cast("long")
    sums = e.groupBy(F.col("event_type").alias("kind"), hour.alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    late = F.col("hour") * 3_600_000_000 >= HALF_US
    value = F.col("cents") / 100
    shapes = {"sparse": F.when(F.col("hour") % 5 < 2, value), "slope": F.col("hour") * F.col("hour") * 1.0, "louder": F.when(late, value * 9).otherwise(value)}
    rows = sums.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}-"), "kind").alias("series"), (F.col("hour") * 3_600_000_000).alias("us"), v.cast("double").alias("storage")) for k, v in shapes.items()])).alias("r")).select("r.*")
    spans = [Span("first", START_US, HALF_US), Span("second", HALF_US, START_US + 30 * DAY_US)]
    table = reading_noise.reading_noise(rows, tuning.windows_frame(rows, spans))
    return reading_noise.reading_noise_warnings(table)


QUERIES |= {f.__name__: f for f in (even_autocorrelation, frozen_evaluation, frozen_windows, frozen_warnings, identifiability, reading_noise_alerts)}

_HOURLY = """ex AS (SELECT unnest(['all', CAST(user_id % 2 AS VARCHAR)]) AS series, epoch_us(ts) // 3600000000 * 3600000000 AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
even AS (SELECT series, us, CAST(sum(cents) AS DOUBLE) / 100 AS storage FROM ex GROUP BY 1, 2)"""
_READINGS = """hh AS (SELECT event_type AS series, epoch_us(ts) // 3600000000 AS hour, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY 1, 2),
hr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY hour) > 2 AS late FROM hh),
obs AS (SELECT series, hour * 3600000000 AS us, CASE WHEN NOT (late AND hour % 7 = 0) THEN 1000 + CAST(cents AS DOUBLE) / 1000 END AS storage, CASE WHEN NOT (late AND hour % 11 = 0) THEN CAST(n AS DOUBLE) END AS outflow FROM hr)"""


def _on_readings(sql: str) -> str:
    return sql.replace(oracle.OBS, _READINGS)


def _largest(channel: str) -> str:
    """CTEs with the largest absolute autocorrelation of a deviation at multiples of the series' cadence, and its lag."""
    c = channel
    return f"""m_{c} AS (SELECT series, us, {c}_z - avg({c}_z) OVER (PARTITION BY series) AS x FROM inside WHERE {c}_z IS NOT NULL),
pr_{c} AS (SELECT a.series, lag_us, a.x AS x0, b.x AS x1 FROM m_{c} a JOIN lags l USING (series) JOIN m_{c} b ON a.series = b.series AND b.us > a.us AND b.us BETWEEN a.us + lag_us - tol AND a.us + lag_us + tol),
g_{c} AS (SELECT series, lag_us, sum(x0 * x1) / sqrt(sum(x0 * x0) * sum(x1 * x1)) AS r FROM pr_{c} GROUP BY 1, 2 HAVING count(*) >= 3 AND sqrt(sum(x0 * x0) * sum(x1 * x1)) > 0),
best_{c} AS (SELECT series, abs(r) AS r, lag_us / 1e6 AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, lag_us) AS k FROM g_{c}) WHERE k = 1)"""


_POOLED = queries.ORACLE_SQL["pooled_metrics"].rsplit(" SELECT series, ", 1)[1]
_CHANNELS = ("storage", "outflow", "conditional_storage")
_FROZEN = f"""{_on_readings(queries._COUNTED)}, gaps AS (SELECT series, min(gap) AS gap FROM (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us) AS gap FROM inside) GROUP BY series),
lags AS (SELECT series, unnest(generate_series(gap, {DAY_US} + (gap + 1) // 2 - 1, gap)) AS lag_us, greatest(gap // 4, 1000000) AS tol FROM gaps),
{", ".join(map(_largest, _CHANNELS))},
pooled AS (SELECT p.*, {", ".join(f"{c}.r AS max_{c}_elapsed_lag_autocorrelation, {c}.seconds AS max_{c}_elapsed_lag_seconds" for c in _CHANNELS)}, greatest({", ".join(f"{c}.r" for c in _CHANNELS)}) AS max_material_elapsed_lag_autocorrelation
  FROM (SELECT series, {_POOLED.replace(", 5)", ", 12)")}) p {" ".join(f"LEFT JOIN best_{c} {c} ON {c}.series = p.series" for c in _CHANNELS)})"""
_METRICS = [x.split(" AS ")[-1].split(" ")[0] for x in _POOLED.split(", round(")]
_METRICS = [m.strip() for m in _METRICS] + [f"max_{c}_elapsed_lag_{k}" for c in _CHANNELS for k in ("autocorrelation", "seconds")] + [scores.MATERIAL]
_CHECKED = [*queries._CHECKS, (scores.MATERIAL, 0.0, 0.25)]


def _total(k: int, q: tuple, r: tuple) -> str:
    """The negative log density of all counted readings in the windows, for one candidate."""
    own = queries._COUNTED.replace(queries._FILTER, oracle.filter_sql(q, r, queries.P0, queries.FACTOR))
    return f"SELECT {k} AS k, t FROM (WITH RECURSIVE {own} SELECT sum(joint_nlpd) AS t FROM inside)"


def _hesse_sql() -> str:
    """Nine totals about the base, second differences, and the inverse of the matrix that they make."""
    points = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    at = lambda a, b: (queries.Q, (queries.R[0] * math.exp(a * HESSE), queries.R[1] * math.exp(b * HESSE)))
    totals = " UNION ALL ".join(_total(k, *at(a, b)) for k, (a, b) in enumerate(points))
    pick = lambda k: f"max(CASE WHEN k = {k} THEN t END)"
    return f"""WITH totals AS ({totals}), h AS (SELECT ({pick(1)} - 2 * {pick(0)} + {pick(2)}) / {HESSE**2!r} AS a, ({pick(3)} - 2 * {pick(0)} + {pick(4)}) / {HESSE**2!r} AS d, ({pick(5)} - {pick(6)} - {pick(7)} + {pick(8)}) / {4 * HESSE**2!r} AS b FROM totals)
SELECT unnest(['r_storage', 'r_outflow']) AS term, round(unnest([sqrt(d / (a * d - b * b)), sqrt(a / (a * d - b * b))]), 4) AS standard_error, round(-b / sqrt(a * d), 4) AS correlation FROM h"""


_ALERTS = f"""WITH hh AS (SELECT event_type AS kind, epoch_us(ts) // 3600000000 AS hour, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2),
sh AS (SELECT kind, hour, unnest(['sparse', 'slope', 'louder']) AS shape, unnest([CASE WHEN hour % 5 < 2 THEN CAST(cents AS DOUBLE) / 100 END, CAST(hour * hour AS DOUBLE), CAST(cents AS DOUBLE) / 100 * CASE WHEN hour * 3600000000 >= {HALF_US} THEN 9 ELSE 1 END]) AS storage FROM hh),
even AS (SELECT shape || '-' || kind AS series, hour * 3600000000 AS us, storage FROM sh WHERE storage IS NOT NULL)"""
_NOISE = queries.ORACLE_SQL["reading_noise_table"]
ORACLE_SQL |= {
    "even_autocorrelation": queries.ORACLE_SQL["cadence_autocorrelation"].replace(queries._EVEN, _HOURLY).replace(f"{DAY_US} + (gap", f"{2 * DAY_US} + (gap"),
    "frozen_evaluation": f"WITH RECURSIVE {_FROZEN} SELECT series, {', '.join(f'round({m}, 4) AS {m}' for m in _METRICS)} FROM pooled",
    "frozen_windows": _on_readings(queries.ORACLE_SQL["window_scores"]),
    "frozen_warnings": f"WITH RECURSIVE {_FROZEN}, each AS ({' UNION ALL '.join(f'''SELECT series, '{m}' AS metric, {m} AS value, CAST({low!r} AS DOUBLE) AS low, CAST({high!r} AS DOUBLE) AS high FROM pooled''' for m, low, high in _CHECKED)}) SELECT series, metric, round(value, 4) AS value, round(low, 4) AS low, round(high, 4) AS high FROM each WHERE value IS NULL OR value < low OR value > high",
    "identifiability": _hesse_sql(),
    "reading_noise_alerts": f"""WITH tab AS ({_NOISE.replace("WITH " + queries._EVEN, _ALERTS).replace(", 3) AS r_storage", ", 12) AS r_storage")}), z AS (SELECT series, "window" AS w, r_storage AS r FROM tab),
sp AS (SELECT series, arg_min(w, r) AS low, arg_max(w, r) AS high, max(r) / min(r) AS times, count(*) AS n FROM z WHERE w <> 'all' AND r > 0 GROUP BY series)
SELECT series, 'no estimate: too few evenly spaced pairs' AS warning FROM z WHERE w = 'all' AND r IS NULL UNION ALL SELECT series, 'no estimate: changes are not negatively correlated' FROM z WHERE w = 'all' AND r = 0
UNION ALL SELECT series, w || ' gave no estimate' FROM z WHERE w <> 'all' AND r = 0 UNION ALL SELECT series, 'reading noise differs between ' || low || ' and ' || high FROM sp WHERE n > 1 AND times > 4""",
}


def metric_filtered(spark, sf_dir):
    """The observations and the configuration taken to metric units, filtered, and the inflow taken back: the same as in US units."""
    volume, flow = US.factors_to(SI)
    obs = event_observations(spark, sf_dir)
    scaled = obs.select("series", "us", (F.col("storage") * volume).alias("storage"), (F.col("outflow") * flow).alias("outflow"))
    out = estimate.states(scaled, CONFIG.in_units(SI))
    return _rounded(out.select("series", "us", (F.col("m1") / flow).alias("estimated_inflow"), (F.sqrt("p11") / flow).alias("deviation")), "estimated_inflow", "deviation", digits=4)


def candidate_gain(spark, sf_dir):
    """What a setting with twice the inflow noise gains over the base in each series: the weighted mean over the windows, a reading, and its standard error."""
    obs = event_observations(spark, sf_dir)
    windows = queries._three(obs)
    rows, single = tuning.windowed_steps(staged(prepare.steps(obs), "steps"), windows, SETTINGS)
    base = tuning.of_config(CONFIG)
    other = tuning.Candidate((base.values[0], 2 * base.values[1], *base.values[2:]))
    found = tuning.candidate_sums(rows, single, CONFIG, [base, other]).withColumn("loss", candidates.mean_loss())
    gains = found.groupBy("series", "name").agg(F.sum(F.when(F.col("candidate") == 0, F.col("loss")).otherwise(-F.col("loss"))).alias("gain"), F.count("loss").alias("both")).filter("both = 2")
    return _rounded(tuning.paired_gains(gains.join(windows.select("series", "name", "weight"), ["series", "name"])), "gain", "error")


def noise_tuning(spark, sf_dir):
    """A short tuning of hourly readings: every setting that was scored, with its objective, and which was selected."""
    spans = [Span(f"w{i}", START_US + 10 * i * DAY_US, START_US + 10 * (i + 1) * DAY_US) for i in range(3)]
    settings = tuning.TuningSettings(evaluations=45, local_searches=1, check_identifiability=False)
    out = tuning.tune(_hourly_readings(spark, sf_dir), CONFIG, spans, SETTINGS, settings)
    return out["candidates"]


QUERIES |= {f.__name__: f for f in (metric_filtered, candidate_gain, noise_tuning)}
_GAIN = lambda k, q: f"SELECT {k} AS k, series, name, loss FROM (WITH RECURSIVE {queries._COUNTED.replace(queries._FILTER, oracle.filter_sql(q, queries.R, queries.P0, queries.FACTOR))} SELECT series, name, sum(joint_nlpd) / sum(CASE WHEN joint_nlpd IS NOT NULL THEN joint_components END) AS loss FROM inside GROUP BY series, name)"
ORACLE_SQL |= {
    "metric_filtered": f"WITH RECURSIVE {queries._FILTER} SELECT series, us, round(m1, 4) AS estimated_inflow, round(sqrt(p11), 4) AS deviation FROM rec",
    # Over windows of equal weight the weighted standard error is the plain one of a mean.
    "candidate_gain": f"""WITH losses AS ({_GAIN(0, queries.Q)} UNION ALL {_GAIN(1, (queries.Q[0], 2 * queries.Q[1], queries.Q[2]))}),
g AS (SELECT a.series, a.loss - b.loss AS gain FROM losses a JOIN losses b ON a.k = 0 AND b.k = 1 AND a.series = b.series AND a.name = b.name WHERE a.loss IS NOT NULL AND b.loss IS NOT NULL)
SELECT series, round(avg(gain), 6) AS gain, round(CASE WHEN count(*) > 1 THEN stddev_samp(gain) / sqrt(count(*)) ELSE 0 END, 6) AS error, count(*) AS windows FROM g GROUP BY series""",
}
