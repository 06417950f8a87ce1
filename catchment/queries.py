"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions.columns import micros, with_previous
from .functions.units import SI, US, hourly_sd_of_q, valid_flow
from .operators import align, estimate, prepare, reading_noise, scores, validation
from .operators.filtering import WaterBalance, filtered, smoothed
from .plans import tuning
from .plans.config import ScoreSettings, SeriesConfig
from .plans.config import Window as Span
from .sources import gauges
from .sources.shared import new_dir, staged
from .streaming.inflow import stream_estimates

DAY_US = 86_400_000_000
Q, R, P0 = (1e-4, 2e-4, 1e-4), (0.25, 4.0), (100.0, 1000.0, 1000.0)
CONFIG = SeriesConfig.diagonal(q=Q, r=R, lag=timedelta(days=2))
SETTINGS = ScoreSettings(warmup=timedelta(days=2))
FACTOR = "(CAST(1 AS DOUBLE) / CAST(43560 AS DOUBLE))"
# 2024-01-01; the events table covers the thirty days behind it.
START_US = 1_704_067_200_000_000
LAG_HOURS = 48
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series with gaps out of the events table: one per user, the last event of a time.

    storage is 1000 + value / 10, missing for clicks and errors; outflow is the value, missing for errors and for
    signups from the third storage reading on.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))
    last = prepare.keep_last(events, ["user_id", "us"], ["event_id"])
    storage = F.when(~F.col("event_type").isin("click", "error"), 1000 + F.col("value") / 10)
    rows = last.select(F.col("user_id").cast("string").alias("series"), "us", "event_type", "value", storage.alias("storage"))
    third = rows.filter("storage IS NOT NULL").select("series", "us", F.row_number().over(Window.partitionBy("series").orderBy("us")).alias("n")).filter("n = 3").select("series", F.col("us").alias("third_us"))
    known = rows.join(third, "series", "left")
    gone = (F.col("event_type") == "error") | ((F.col("event_type") == "signup") & (F.col("us") >= F.col("third_us")))
    return staged(prepare.observations(known, "series", "us", "storage", F.when(~F.coalesce(gone, F.lit(False)), F.col("value"))), "observations")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, row, us, value): events as gauge sources named by their type; some times and values are missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.when(F.col("event_id") % 97 != 0, F.floor(micros("ts") / 900_000_000) * 900_000_000).cast("long")
    return e.select(F.col("event_type").alias("name"), F.col("event_id").alias("row"), us.alias("us"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))


SOURCES_SQL = "raw AS (SELECT event_type AS name, event_id AS row, CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) // 900000000 * 900000000 END AS us, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events)"
CLEAN_SQL = SOURCES_SQL + ", clean AS (SELECT name, us, max_by(coalesce(value, 'NaN'), row) AS v FROM raw WHERE us IS NOT NULL GROUP BY name, us), series AS (SELECT name, us, CASE WHEN NOT isnan(v) THEN v END AS value FROM clean)"


def observations(spark, sf_dir):
    return event_observations(spark, sf_dir)


def filter_steps(spark, sf_dir):
    return _rounded(prepare.steps(event_observations(spark, sf_dir)).select("series", "us", "storage", "outflow", "dt", "first_us", "second_us"), "dt")


def order_faults(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), (F.floor(micros("ts") / 600_000_000) * 600_000_000).cast("long").alias("us"))
    return prepare.order_faults(rows)


def model_steps(spark, sf_dir):
    """What the water balance does between readings: entries of F and of Q, as the filter takes them."""
    steps = prepare.steps(event_observations(spark, sf_dir)).filter("dt IS NOT NULL")
    model, entries = WaterBalance(CONFIG), {"q00": (0, 0), "q01": (0, 1), "q02": (0, 2), "q11": (1, 1), "q22": (2, 2)}

    def work(frames):
        for df in frames:
            f, q = model.transitions(df), model.process(df)
            yield df[["series", "us"]].assign(volume_per_flow=f[:, 0, 1], **{k: q[:, i, j] for k, (i, j) in entries.items()})

    out = steps.select("series", "us", "dt").mapInPandas(work, "series string, us long, volume_per_flow double, " + ", ".join(f"{k} double" for k in entries))
    return _rounded(out, "volume_per_flow", *entries)


def inflow_filtered(spark, sf_dir):
    out = estimate.states(event_observations(spark, sf_dir), CONFIG)
    flag = F.when(F.col("storage").isNotNull() & F.col("outflow").isNotNull(), "NORMAL").otherwise("PREDICTED")
    return _rounded(out.select("series", "us", F.col("m0").alias("storage_state"), F.col("m1").alias("estimated_inflow"), F.col("m2").alias("outflow_state"), estimate.deviation("p11").alias("deviation"), flag.alias("flag")), "storage_state", "estimated_inflow", "outflow_state", "deviation", digits=5)


def inflow_estimate(spark, sf_dir):
    """Every reading with its causal and revised estimate and their flags."""
    out = estimate.estimate(event_observations(spark, sf_dir), CONFIG)
    return _rounded(out, "estimated_inflow", "revised_inflow", digits=4)


def inflow_intervals(spark, sf_dir):
    """Estimates with standard deviations and 95 % intervals."""
    out = estimate.with_intervals(estimate.estimate(event_observations(spark, sf_dir), CONFIG, uncertainty=True), 0.95)
    return _rounded(out, *[c for c in out.columns if c.endswith(("inflow", "deviation", "lower", "upper"))], digits=4)


def inflow_provisional(spark, sf_dir):
    """Estimates in which rows that wait for release are smoothed back from their series' last row."""
    out = estimate.estimate(event_observations(spark, sf_dir), CONFIG, provisional=True)
    return _rounded(out.select("series", "us", "revised_inflow", "revised_inflow_flag", "revised_inflow_smoothing_flag"), "revised_inflow", digits=4)


def inflow_revised(spark, sf_dir):
    out = smoothed(estimate.states(event_observations(spark, sf_dir), CONFIG), CONFIG)
    return _rounded(out.filter("released").select("series", "us", F.col("sm0").alias("storage_state"), F.col("sm1").alias("revised_inflow"), F.col("sm2").alias("outflow_state")), "storage_state", "revised_inflow", "outflow_state", digits=4)


def inflow_smoothed_whole(spark, sf_dir):
    out = smoothed(estimate.states(event_observations(spark, sf_dir), CONFIG), CONFIG, whole=True)
    return _rounded(out.select("series", "us", F.col("sm1").alias("smoothed_inflow"), F.sqrt("sp11").alias("deviation")), "smoothed_inflow", "deviation", digits=4)


def smoothed_in_spans(spark, sf_dir):
    """Whole smoothing with spans of two days composed, which must give what one span gives."""
    out = smoothed(estimate.states(event_observations(spark, sf_dir), CONFIG), CONFIG, whole=True, span=2 * DAY_US)
    return _rounded(out.select("series", "us", F.col("sm1").alias("smoothed_inflow")), "smoothed_inflow", digits=4)


def inflow_log_likelihood(spark, sf_dir):
    out = _scores(event_observations(spark, sf_dir))
    return _rounded(out.groupBy("series").agg(F.sum(-F.col("joint_nlpd")).alias("log_likelihood"), F.count("*").alias("steps")), "log_likelihood", digits=4)


def release_times(spark, sf_dir):
    return prepare.release_times(event_observations(spark, sf_dir).select("series", "us"), CONFIG.lag_us)


def active_counts(spark, sf_dir):
    return prepare.active_counts(event_observations(spark, sf_dir).select("series", "us"), CONFIG.lag_us)


def validation_windows(spark, sf_dir):
    w = prepare.split_windows(event_observations(spark, sf_dir).filter("storage IS NOT NULL"), 6)
    return w.withColumn("weight", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("series")), 6))


def window_faults(spark, sf_dir):
    w = prepare.split_windows(event_observations(spark, sf_dir), 4)
    odd = w.withColumn("start_us", F.when(F.col("name") == "window-3", F.col("start_us") - 1).otherwise(F.col("start_us")))
    return prepare.window_faults(odd)


def window_capacity(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    windows = prepare.split_windows(obs, 6)
    return prepare.window_capacity(prepare.steps(obs), windows, 2 * DAY_US, 5)


def _three(obs: DataFrame) -> DataFrame:
    return tuning.windows_frame(obs, [Span(f"w{i}", START_US + 10 * i * DAY_US, START_US + 10 * (i + 1) * DAY_US) for i in range(3)])


def _scores(obs: DataFrame) -> DataFrame:
    return scores.row_scores(estimate.states(obs, CONFIG, columns=scores.READS))


def row_scores(spark, sf_dir):
    names = ["joint_nlpd", "joint_nis", "storage_nlpd", "storage_z", "outflow_z", "conditional_storage_z"]
    return _rounded(_scores(event_observations(spark, sf_dir)).select("series", "us", "joint_components", *names), *names, digits=5)


WINDOW_METRICS = ("storage_nlpd", "joint_nlpd", "joint_nis", "storage_nis", "outflow_nis", "conditional_storage_nis", "storage_bias", "outflow_bias", "conditional_storage_bias", "scored_fraction")


def window_scores(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    rows = scores.window_scores(_scores(obs), _three(obs), SETTINGS).drop("unscorable_count")
    return _rounded(rows, *WINDOW_METRICS, digits=5)


def pooled_metrics(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    out = scores.pooled_metrics(_scores(obs), _three(obs), SETTINGS)
    return _rounded(out, *[c for c in out.columns if c not in ("series", "inflow_change_median_per_second", "inflow_change_q95_per_second")], digits=5).drop("inflow_change_median_per_second", "inflow_change_q95_per_second")


def inflow_changes(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    out = scores.pooled_metrics(_scores(obs), _three(obs), SETTINGS)
    return _rounded(out.select("series", (F.col("inflow_change_median_per_second") * 1e6).alias("median"), (F.col("inflow_change_q95_per_second") * 1e6).alias("q95")), "median", "q95", digits=3)


def calibration_warnings(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    out = scores.calibration_warnings(scores.calibration_metrics(_scores(obs), _three(obs), SETTINGS), SETTINGS)
    return _rounded(out, "value", "low", "high", digits=4)


def candidate_validity(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    return scores.validity(scores.window_scores(_scores(obs), _three(obs), SETTINGS), ScoreSettings(warmup=timedelta(days=2), least_scored=8)).withColumn("reasons", F.array_join("reasons", "; "))


def noise_screening(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    base = tuning.of_config(CONFIG)
    candidates = [base, tuning.Candidate((1e-4, 1e-3, 1e-4, 0.25, 4.0)), tuning.Candidate((1e-4, 2e-5, 1e-4, 0.5, 4.0))]
    windows = _three(obs)
    rows, single = tuning.windowed_steps(staged(prepare.steps(obs), "steps"), windows, SETTINGS)
    found = tuning.candidate_sums(rows, single, CONFIG, candidates)
    return _rounded(tuning.objective(found, len(candidates), windows, SETTINGS).select("candidate", "series", "objective"), "objective", digits=5)


def autocorrelation(spark, sf_dir):
    rows = event_observations(spark, sf_dir)
    lags = [DAY_US * k // 2 for k in range(1, 9)]
    return _rounded(scores.autocorrelation(rows, "outflow", lags, DAY_US // 8), "autocorrelation")


def innovation_autocorrelation(spark, sf_dir):
    rows = _scores(event_observations(spark, sf_dir))
    lags = [DAY_US * k // 2 for k in range(1, 9)]
    found = scores.largest_autocorrelation(scores.autocorrelation(rows, "storage_z", lags, DAY_US // 8))
    return _rounded(found, "largest", digits=5)


def cadence_autocorrelation(spark, sf_dir):
    """Autocorrelation at the multiples of each series' own shortest interval."""
    rows = _even(spark, sf_dir)
    return _rounded(scores.autocorrelation(rows, "storage", scores.cadence_lags(rows, DAY_US)), "autocorrelation", digits=5)


def positional_lags(spark, sf_dir):
    """Outflow against storage by rows, three earlier to three later."""
    rows = event_observations(spark, sf_dir)
    return _rounded(scores.positional_lags(rows, "outflow", "storage", list(range(-3, 4))), "correlation", digits=5)


def frame_faults(spark, sf_dir):
    """Faults of ten-minute readings, twenty series to a user: repeated times and series with too few storage readings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.floor(micros("ts") / 600_000_000) * 600_000_000
    obs = e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.expr("cast(event_id % 20 AS string)")).alias("series"), us.cast("long").alias("us"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("storage"))
    return prepare.frame_faults(obs)


def noise_units(spark, sf_dir):
    """Hourly deviations of the values taken as noise per second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value IS NOT NULL")
    return _rounded(e.select("event_id", hourly_sd_of_q(F.abs("value")).alias("hourly_sd")), "hourly_sd", digits=5)


def _even(spark, sf_dir):
    """Hourly sums of the events' values, a series per type: dense and mostly evenly spaced."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = (F.floor(micros("ts") / 3_600_000_000) * 3_600_000_000).cast("long")
    return e.groupBy(F.col("event_type").alias("series"), us.alias("us")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select("series", "us", (F.col("cents") / 100).alias("storage"))


def reading_noise_table(spark, sf_dir):
    rows = _even(spark, sf_dir)
    out = reading_noise.reading_noise(rows, tuning.windows_frame(rows, [Span("first", START_US, START_US + 15 * DAY_US), Span("second", START_US + 15 * DAY_US, START_US + 30 * DAY_US)]))
    return _rounded(out.select("series", "window", "r_storage", "pairs", "blocks", "unchanged_share"), "r_storage", "unchanged_share", digits=3)


def reading_noise_warnings(spark, sf_dir):
    rows = _even(spark, sf_dir)
    table = reading_noise.reading_noise(rows, tuning.windows_frame(rows, [Span("first", START_US, START_US + 15 * DAY_US), Span("second", START_US + 15 * DAY_US, START_US + 30 * DAY_US)]))
    return reading_noise.reading_noise_warnings(table)


def proxy_check(spark, sf_dir):
    wide = _even(spark, sf_dir)
    a = wide.filter("series <> 'view'").select("series", "us", F.col("storage").alias("estimate"))
    b = wide.filter("series = 'view'").select("us", F.col("storage").alias("proxy"))
    out = reading_noise.proxy_check(a.join(b, "us"))
    return _rounded(out, "proxy_shape_correlation", "proxy_change_correlation")


def exported_sources(spark, sf_dir):
    """The sources written as exports (header lines, CSV) and read back: clean series."""
    return gauges.clean(_exports(spark, sf_dir)[0])


def exported_audit(spark, sf_dir):
    """The audit of the same exports, with their header fields."""
    rows, heads = _exports(spark, sf_dir)
    return _rounded(gauges.source_audit(rows, headers=heads).drop("path"), "finite_value_fraction", "median_interval_min")


def _exports(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(readings, headers) of one export per event type: the types' rows as text lines in the order of event_id, with three header lines."""
    own = _sources(spark, sf_dir)
    text = F.concat(F.coalesce(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown")), F.lit(","), F.coalesce(F.col("value").cast("string"), F.lit("---")))
    lines = own.select("name", "row", text.alias("value"))
    heads = [f"# Time-series identifier: {{}}", "# Location:  here ", "# Value units: ft", f"{gauges.TIME},{gauges.VALUE}"]
    paths = {}
    for name in EVENT_TYPES:
        paths[name] = new_dir(spark, f"export-{name}")
        top = spark.createDataFrame([(i - len(heads), h.format(name)) for i, h in enumerate(heads)], "row long, value string")
        # One export is one file, as an agency's download is.
        lines.filter(F.col("name") == name).select("row", "value").unionByName(top).repartition(1).sortWithinPartitions("row").select("value").write.text(paths[name])
    return gauges.read_sources(spark, paths)


def clean_sources(spark, sf_dir):
    return gauges.clean(_sources(spark, sf_dir))


def source_audit(spark, sf_dir):
    return _rounded(gauges.source_audit(_sources(spark, sf_dir)), "finite_value_fraction", "median_interval_min")


def _aligned(spark, sf_dir):
    rows = gauges.clean(_sources(spark, sf_dir)).withColumn("series", F.lit("all"))
    clock = rows.filter("name = 'view'").select("series", "us", F.col("value").alias("storage"))
    names = {"click": "outlet", "purchase": "spillway", "signup": "upstream"}
    pick = F.when(F.col("name") == "click", "outlet").when(F.col("name") == "purchase", "spillway").when(F.col("name") == "signup", "upstream")
    readings = rows.filter(F.col("name").isin(*names)).select("series", "us", pick.alias("source"), F.when(pick == "spillway", F.col("value") - 20).otherwise(F.col("value")).alias("value"))
    return align.asof(clock, readings, 10_800_000_000)


def asof_aligned(spark, sf_dir):
    out = _aligned(spark, sf_dir)
    for name in ("outlet", "spillway", "upstream"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select("series", "us", "storage", "outlet", "spillway", "upstream")


def _combined(spark, sf_dir):
    return align.from_first_joint(align.combined_outflow(asof_aligned(spark, sf_dir), START_US + 2 * DAY_US, START_US + 20 * DAY_US))


def combined_outflow(spark, sf_dir):
    return _rounded(_combined(spark, sf_dir).select("series", "us", "storage", "outflow", "spillway_used", "spillway_unknown", "outflow_definition"), "outflow")


def window_audit(spark, sf_dir):
    return _rounded(align.window_audit(_combined(spark, sf_dir)), "median_interval_min")


def outer_aligned(spark, sf_dir):
    rows = gauges.clean(_sources(spark, sf_dir)).withColumn("series", F.lit("all"))
    return align.outer_aligned(rows.filter("name = 'view'"), rows.filter("name = 'click'"))


def shared_times(spark, sf_dir):
    rows = gauges.clean(_sources(spark, sf_dir)).withColumn("series", F.lit("all"))
    return align.shared_times(rows.filter("name = 'view'"), rows.filter("name = 'click'"))


def unmatched_times(spark, sf_dir):
    rows = gauges.clean(_sources(spark, sf_dir)).withColumn("series", F.lit("all"))
    return align.unmatched_times(rows.filter("name = 'view'"), rows.filter("name = 'click'"))


def _comparison(spark, sf_dir):
    """Hourly comparison columns, a series per user modulo 8: storage and flows out of the events' values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select((F.col("user_id") % 8).cast("string").alias("series"), micros("ts").alias("us"), "value", "event_id", "event_type")
    one = prepare.keep_last(rows, ["series", "us"], ["event_id"])
    v = F.col("value")
    return one.select(
        "series",
        "us",
        (1000 + v / 10).alias("storage"),
        F.when(F.col("event_type") != "error", v).alias("outflow"),
        (v * 2 - 3).alias("estimated_inflow"),
        F.when(F.col("event_id") % 3 != 0, v - 5).alias("revised_inflow"),
        F.when(F.col("event_id") % 5 != 0, 40 - v / 2).alias("upstream_flow"),
    )


def validation_frame(spark, sf_dir):
    out = validation.validation_frame(_comparison(spark, sf_dir))
    return _rounded(out, *[c for c in out.columns if c not in ("series", "us")])


def _estimates(spark, sf_dir):
    return validation.by_estimate(validation.validation_frame(_comparison(spark, sf_dir)))


def proxy_agreement(spark, sf_dir):
    out = validation.agreement(_estimates(spark, sf_dir), 3)
    return _rounded(out, *[c for c in out.columns if c not in ("series", "estimate", "paired_observations")], digits=5)


def lag_curve(spark, sf_dir):
    return _rounded(validation.lagged_correlations(_estimates(spark, sf_dir), LAG_HOURS, 3), "correlation", digits=5)


def best_lags(spark, sf_dir):
    out = validation.best_lags(validation.lagged_correlations(_estimates(spark, sf_dir), LAG_HOURS, 3))
    return _rounded(out, "zero_lag_pearson_correlation", "max_correlation", "improvement_over_zero_lag", digits=5)


def frozen_lags(spark, sf_dir):
    rows = _estimates(spark, sf_dir)
    split = START_US + 15 * DAY_US
    curves = [validation.lagged_correlations(validation.between(rows, p), LAG_HOURS, 3) for p in ((None, split), (split + validation.HOUR_US, None))]
    return _rounded(validation.frozen_lags(*curves), "zero_lag_pearson_correlation", "max_correlation", "improvement_over_zero_lag", digits=5)


def storage_closure(spark, sf_dir):
    out = validation.closure(_estimates(spark, sf_dir))
    return _rounded(out, *[c for c in out.columns if c not in ("series", "estimate", "paired_observations")], digits=4)


def inflow_behavior(spark, sf_dir):
    out = validation.behavior(_estimates(spark, sf_dir))
    return _rounded(out, *[c for c in out.columns if c not in ("series", "estimate", "finite_observations")], digits=5)


def unit_conversions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    timed = with_previous(e.select(F.col("user_id").cast("string").alias("series"), micros("ts").alias("us"), "value", "event_id").transform(lambda d: prepare.keep_last(d, ["series", "us"], ["event_id"])), "series", ["us"], "before")
    seconds = prepare.elapsed_seconds(F.col("us"), F.col("before.us"))
    volume, flow = US.factors_to(SI)
    return _rounded(timed.select("series", "us", US.volume_of(F.col("value"), seconds).alias("volume"), US.flow_of(F.col("value"), seconds).alias("flow"), (F.col("value") * volume).alias("cubic_metres"), (F.col("value") * flow).alias("cubic_metres_per_second"), valid_flow(F.col("value")).alias("valid")), "volume", "flow", "cubic_metres", "cubic_metres_per_second", digits=5)


def streamed(spark: SparkSession, parts: list[DataFrame]) -> tuple[DataFrame, str]:
    """(what the streaming estimator puts out, its checkpoint folder): each part of the observations is a run of its own that goes on from the state of the run before."""
    folder, out, check = (new_dir(spark, n) for n in ("readings", "stream", "offsets"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(prepare.OBSERVATION).parquet(folder)
        query = stream_estimates(stream, CONFIG).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream_schema()).parquet(out), check


def inflow_stream(spark, sf_dir):
    """The streaming estimator over the observations: stopped half-way and started again on the rest."""
    obs, half = event_observations(spark, sf_dir), START_US + 15 * DAY_US
    out, _ = streamed(spark, [obs.filter(F.col("us") < half), obs.filter(F.col("us") >= half)])
    return _rounded(out.filter("kind <> 'rejected'"), "value", digits=4).select("series", "us", "kind", "value", "prediction_flag", "smoothing_flag")


def stream_rejected(spark, sf_dir):
    """Readings that come a second time, behind all others of their series: the stream must reject each."""
    folder, out, check = (new_dir(spark, n) for n in ("readings", "stream", "offsets"))
    obs = event_observations(spark, sf_dir)
    obs.repartition(1).write.parquet(folder)
    obs.filter("us div 1000000 % 7 = 0").repartition(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(prepare.OBSERVATION).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream_estimates(stream, CONFIG).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream_schema()).parquet(out).filter("kind = 'rejected'").select("series", "us", "kind")


def stream_schema() -> str:
    from .streaming.inflow import OUTPUT

    return OUTPUT


def filter_in_spans(spark, sf_dir):
    """The filter with spans of two days composed, which must give what one span gives."""
    out = filtered(prepare.steps(event_observations(spark, sf_dir)), CONFIG, 2 * DAY_US)
    return _rounded(out.select("series", "us", F.col("m1").alias("estimated_inflow")), "estimated_inflow", digits=5)


QUERIES = {
    f.__name__: f
    for f in (
        observations, order_faults, filter_steps, model_steps, inflow_filtered, inflow_estimate, inflow_intervals, inflow_revised, inflow_smoothed_whole, smoothed_in_spans, inflow_provisional, inflow_log_likelihood, filter_in_spans, inflow_stream, stream_rejected,
        release_times, active_counts, validation_windows, window_faults, window_capacity, row_scores, window_scores, pooled_metrics, inflow_changes, calibration_warnings, candidate_validity, noise_screening,
        autocorrelation, innovation_autocorrelation, cadence_autocorrelation, positional_lags, frame_faults, noise_units, exported_sources, exported_audit, reading_noise_table, reading_noise_warnings, proxy_check, clean_sources, source_audit, asof_aligned, combined_outflow, window_audit,
        outer_aligned, shared_times, unmatched_times, validation_frame, proxy_agreement, lag_curve, best_lags, frozen_lags, storage_closure, inflow_behavior, unit_conversions,
    )
}

_FILTER = oracle.filter_sql(Q, R, P0, FACTOR)
_LAG = 2 * DAY_US
_THREE = "win AS (SELECT 'w' || i AS name, %d + CAST(i AS BIGINT) * %d AS start_us, %d + (CAST(i AS BIGINT) + 1) * %d AS end_us FROM range(3) t(i))" % (START_US, 10 * DAY_US, START_US, 10 * DAY_US)
_SCORES = _FILTER + """, sc AS (SELECT *, s00 - s01 * s01 / s11 AS a_c, s11 - s01 * s01 / s00 AS c_a, CAST(storage IS NOT NULL AS INT) + CAST(outflow IS NOT NULL AS INT) AS joint_components FROM rec),
scored AS (SELECT *,
  CASE WHEN joint_components = 2 THEN v0 * v0 / s00 + (v1 - s01 * v0 / s00) * (v1 - s01 * v0 / s00) / c_a WHEN storage IS NOT NULL THEN v0 * v0 / s00 WHEN outflow IS NOT NULL THEN v1 * v1 / s11 END AS joint_nis,
  CASE WHEN joint_components = 2 THEN ln(s00 * c_a) WHEN storage IS NOT NULL THEN ln(s00) WHEN outflow IS NOT NULL THEN ln(s11) END AS log_det,
  CASE WHEN joint_components = 2 THEN 0.5 * (ln(2 * pi()) + ln(a_c) + (v0 - s01 * v1 / s11) * (v0 - s01 * v1 / s11) / a_c) WHEN storage IS NOT NULL THEN 0.5 * (ln(2 * pi()) + ln(s00) + v0 * v0 / s00) END AS storage_nlpd,
  v0 / sqrt(s00) AS storage_z, v1 / sqrt(s11) AS outflow_z, CASE WHEN joint_components = 2 THEN (v0 - s01 * v1 / s11) / sqrt(a_c) END AS conditional_storage_z FROM sc),
rows_ AS (SELECT *, 0.5 * (joint_components * ln(2 * pi()) + log_det + joint_nis) AS joint_nlpd FROM scored),
counted AS (SELECT * FROM rows_ WHERE us > second_us AND us >= second_us + %d)""" % _LAG
_COUNTED = _SCORES + ", " + _THREE + ", inside AS (SELECT counted.*, name FROM counted JOIN win ON us >= start_us AND us < end_us)"
_WINDOW_SCORES = _COUNTED + """, agg AS (SELECT series, name, avg(storage_nlpd) AS storage_nlpd, count(storage_nlpd) AS storage_count, sum(joint_nlpd) / sum(CASE WHEN joint_nlpd IS NOT NULL THEN joint_components END) AS joint_nlpd,
  CAST(coalesce(sum(CASE WHEN joint_nlpd IS NOT NULL THEN joint_components END), 0) AS BIGINT) AS joint_count, sum(joint_nis) / sum(CASE WHEN joint_nis IS NOT NULL THEN joint_components END) AS joint_nis,
  avg(storage_z * storage_z) AS storage_nis, avg(outflow_z * outflow_z) AS outflow_nis, avg(conditional_storage_z * conditional_storage_z) AS conditional_storage_nis,
  avg(storage_z) AS storage_bias, avg(outflow_z) AS outflow_bias, avg(conditional_storage_z) AS conditional_storage_bias, count(storage_nlpd) / count(*) AS scored_fraction FROM inside GROUP BY series, name),
wins AS (SELECT s.series, win.* FROM (SELECT DISTINCT series FROM obs) s, win)"""
_PREVIOUS = "(PARTITION BY series ORDER BY us)"
_EVEN = "e AS (SELECT event_type AS series, epoch_us(ts) // 3600000000 * 3600000000 AS us, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2), even AS (SELECT series, us, CAST(cents AS DOUBLE) / 100 AS storage FROM e)"
_COMPARISON = """c0 AS (SELECT CAST(user_id % 8 AS VARCHAR) AS series, epoch_us(ts) AS us, value AS v, event_id, event_type, row_number() OVER (PARTITION BY user_id % 8, ts ORDER BY event_id DESC) AS rn FROM events),
c1 AS (SELECT series, us, 1000 + v / 10 AS storage, CASE WHEN event_type <> 'error' THEN v END AS outflow, v * 2 - 3 AS estimated_inflow, CASE WHEN event_id % 3 <> 0 THEN v - 5 END AS delayed_revised_inflow,
  CASE WHEN event_id % 5 <> 0 THEN 40 - v / 2 END AS upstream_flow FROM c0 WHERE rn = 1),
c2 AS (SELECT *, (storage - lag(storage) OVER w) / ((us - lag(us) OVER w) / 1e6 * """ + FACTOR + """) + lag(outflow) OVER w AS raw_inflow FROM c1 WINDOW w AS (PARTITION BY series ORDER BY us)),
ends AS (SELECT series, min(us) // 86400000000 * 86400000000 AS origin, max(us) AS last_us, min(us) AS first_us FROM c2 GROUP BY series),
means AS (SELECT c2.series, origin + (us - origin) // 3600000000 * 3600000000 AS us, avg(storage) AS storage, avg(outflow) AS outflow, avg(raw_inflow) AS raw_inflow, avg(estimated_inflow) AS estimated_inflow, avg(delayed_revised_inflow) AS delayed_revised_inflow, avg(upstream_flow) AS upstream_flow
  FROM c2 JOIN ends USING (series) GROUP BY 1, 2),
clock AS (SELECT series, unnest(generate_series(origin + (first_us - origin) // 3600000000 * 3600000000, last_us, 3600000000)) AS us FROM ends),
reg AS (SELECT * FROM clock LEFT JOIN means USING (series, us)),
frame AS (SELECT *, avg(raw_inflow) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN 10799999999 PRECEDING AND 10800000000 FOLLOWING) AS centered_rolling_inflow FROM reg),
est AS (SELECT series, us, storage, outflow, upstream_flow, unnest(['raw_inflow', 'centered_rolling_inflow', 'estimated_inflow', 'delayed_revised_inflow']) AS estimate, unnest([raw_inflow, centered_rolling_inflow, estimated_inflow, delayed_revised_inflow]) AS value FROM frame)"""
_CORR = "CASE WHEN count(*) >= 3 AND least(stddev_pop(value), stddev_pop(upstream_flow)) > 2.220446049250313e-16 THEN corr(value, upstream_flow) END"


def _curve(source: str, name: str) -> str:
    return f"""{name}_pairs AS (SELECT a.series, a.estimate, l.lag_hours, a.value, b.upstream_flow FROM {source} b, (SELECT CAST(unnest(generate_series({-LAG_HOURS}, {LAG_HOURS})) AS INT) AS lag_hours) l, {source} a
  WHERE a.series = b.series AND a.estimate = b.estimate AND a.us = b.us + CAST(l.lag_hours AS BIGINT) * 3600000000 AND a.value IS NOT NULL AND b.upstream_flow IS NOT NULL),
{name}_found AS (SELECT series, estimate, lag_hours, {_CORR} AS correlation, count(*) AS paired_observations FROM {name}_pairs GROUP BY 1, 2, 3),
{name} AS (SELECT k.series, k.estimate, k.lag_hours, correlation, coalesce(paired_observations, 0) AS paired_observations FROM (SELECT * FROM (SELECT DISTINCT series, estimate FROM {source}), (SELECT CAST(unnest(generate_series({-LAG_HOURS}, {LAG_HOURS})) AS INT) AS lag_hours)) k LEFT JOIN {name}_found f USING (series, estimate, lag_hours)),
{name}_best AS (SELECT series, estimate, max(CASE WHEN lag_hours = 0 THEN correlation END) AS zero FROM {name} GROUP BY 1, 2),
{name}_top AS (SELECT *, row_number() OVER (PARTITION BY series, estimate ORDER BY round(correlation, 12) DESC, abs(lag_hours), lag_hours) AS rn FROM {name} WHERE correlation IS NOT NULL),
{name}_lags AS (SELECT b.series, b.estimate, zero, t.correlation AS top, t.lag_hours AS lag, coalesce(t.paired_observations, 0) AS n FROM {name}_best b LEFT JOIN (SELECT * FROM {name}_top WHERE rn = 1) t USING (series, estimate))"""


_NAMED = "named AS (SELECT name, us, value FROM series)"
_ASOF = CLEAN_SQL + """, clk AS (SELECT us, value AS storage FROM series WHERE name = 'view'),
one AS (SELECT clk.us, storage, CASE WHEN clk.us - r.us <= 10800000000 THEN r.value END AS outlet FROM clk ASOF LEFT JOIN (SELECT us, value FROM series WHERE name = 'click') r ON clk.us >= r.us),
two AS (SELECT one.*, CASE WHEN one.us - r.us <= 10800000000 THEN r.value - 20 END AS spillway FROM one ASOF LEFT JOIN (SELECT us, value FROM series WHERE name = 'purchase') r ON one.us >= r.us),
aligned AS (SELECT 'all' AS series, two.*, CASE WHEN two.us - r.us <= 10800000000 THEN r.value END AS upstream FROM two ASOF LEFT JOIN (SELECT us, value FROM series WHERE name = 'signup') r ON two.us >= r.us)"""
_COMBINED = _ASOF + """, cw AS (SELECT *, spillway IS NOT NULL AND spillway >= 0 AS ok, bool_or(spillway IS NOT NULL AND spillway >= 0) OVER () AS joined FROM aligned WHERE us BETWEEN %d AND %d),
co AS (SELECT *, CASE WHEN NOT joined THEN outlet WHEN ok THEN outlet + spillway END AS outflow, joined AND ok AS spillway_used, NOT ok AS spillway_unknown, CASE WHEN joined THEN '%s' ELSE '%s' END AS outflow_definition FROM cw),
joint AS (SELECT * FROM co WHERE us >= (SELECT min(us) FROM co WHERE storage IS NOT NULL AND outflow IS NOT NULL))""" % (START_US + 2 * DAY_US, START_US + 20 * DAY_US, align.JOINED, align.ALONE)
_NT = "w AS (SELECT series, us, ntile(%d) OVER (PARTITION BY series ORDER BY us) AS part FROM (SELECT DISTINCT series, us FROM obs %s)), p AS (SELECT series, part, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM w GROUP BY 1, 2), windows AS (SELECT series, 'window-' || part AS name, start_us, coalesce(lead(start_us) OVER (PARTITION BY series ORDER BY part), last_us + 1) AS end_us, n FROM p)"

_REVISED = oracle.smooth_sql(_FILTER, _LAG, FACTOR)
_FLAG = "CASE WHEN x.storage IS NOT NULL AND x.outflow IS NOT NULL THEN 'NORMAL' ELSE 'PREDICTED' END"
_Z95 = repr(estimate.quantile(0.95))
_CHECKS = [(m, 0.7, 1.5) for m in ("joint_nis", "storage_nis", "outflow_nis")] + [(m, -0.25, 0.25) for m in ("storage_bias", "outflow_bias", "conditional_storage_bias")]
_CHECKS += [(f"{c}_coverage_{level}", level / 100 - 0.1, level / 100 + 0.1) for c in ("storage", "outflow") for level in (50, 90)]
_POOLED = """SELECT series, avg(storage_z) AS storage_bias, avg(outflow_z) AS outflow_bias, avg(conditional_storage_z) AS conditional_storage_bias, sum(joint_nis) / sum(CASE WHEN joint_nis IS NOT NULL THEN joint_components END) AS joint_nis, avg(storage_z * storage_z) AS storage_nis, avg(outflow_z * outflow_z) AS outflow_nis,
  avg(CAST(abs(storage_z) <= 0.6744897501960817 AS INT)) AS storage_coverage_50, avg(CAST(abs(storage_z) <= 1.6448536269514722 AS INT)) AS storage_coverage_90, avg(CAST(abs(outflow_z) <= 0.6744897501960817 AS INT)) AS outflow_coverage_50, avg(CAST(abs(outflow_z) <= 1.6448536269514722 AS INT)) AS outflow_coverage_90 FROM inside GROUP BY series"""


def _screened(k: int, q: tuple, r: tuple) -> str:
    """The objective of one candidate as a query of its own."""
    own = _WINDOW_SCORES.replace(_FILTER, oracle.filter_sql(q, r, P0, FACTOR))
    return f"""SELECT {k} AS candidate, series, objective FROM (WITH RECURSIVE {own} SELECT wins.series, round(CASE WHEN min(coalesce(storage_count, 0)) >= 3 AND count(joint_nlpd) = 3 THEN sum(joint_nlpd) / 3 END, 5) AS objective FROM wins LEFT JOIN agg USING (series, name) GROUP BY wins.series)"""


ORACLE_SQL = {
    "proxy_check": f"""WITH {_EVEN}, j AS (SELECT a.series, a.us, a.storage AS estimate, b.storage AS proxy FROM even a JOIN even b ON a.us = b.us AND b.series = 'view' WHERE a.series <> 'view'),
o AS (SELECT CAST(unnest(generate_series(-12, 12)) AS INT) AS shift), pr AS (SELECT a.series, shift, a.us, a.estimate, b.proxy FROM j a, o, j b WHERE a.series = b.series AND b.us = a.us + CAST(shift AS BIGINT) * 3600000000),
ch AS (SELECT *, estimate - lag(estimate) OVER w AS de, proxy - lag(proxy) OVER w AS dp FROM pr WINDOW w AS (PARTITION BY series, shift ORDER BY us)),
f AS (SELECT series, shift, corr(estimate, proxy) AS shape, coalesce(corr(de, dp), 0) AS change FROM ch GROUP BY 1, 2 HAVING count(*) >= 12 AND corr(estimate, proxy) IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY 0.6 * shape + 0.4 * change DESC, shift) AS rn FROM f), al AS (SELECT series, count(*) AS n FROM j GROUP BY 1)
SELECT al.series, al.n AS proxy_aligned_count, CASE WHEN al.n >= 12 THEN CAST(-shift AS DOUBLE) * 3600 END AS proxy_best_lag_seconds, CASE WHEN al.n >= 12 THEN round(shape, 6) END AS proxy_shape_correlation, CASE WHEN al.n >= 12 THEN round(change, 6) END AS proxy_change_correlation,
al.n >= 12 AND coalesce(shape >= 0.2 AND change >= 0.1, false) AS proxy_check_passed FROM al LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (series)""",
    "inflow_estimate": f"""WITH RECURSIVE {_REVISED}, done AS (SELECT x.series, x.us, x.m1, s1, {_FLAG} AS flag FROM rec x LEFT JOIN (SELECT * FROM back WHERE j = k) b ON b.series = x.series AND b.k = x.n)
SELECT obs.series, obs.us, storage, outflow, round(m1, 4) AS estimated_inflow, round(s1, 4) AS revised_inflow, flag AS estimated_inflow_flag, CASE WHEN s1 IS NOT NULL THEN flag END AS revised_inflow_flag, 'NON_SMOOTHED' AS estimated_inflow_smoothing_flag, CASE WHEN s1 IS NOT NULL THEN 'SMOOTHED' ELSE 'NON_SMOOTHED' END AS revised_inflow_smoothing_flag
FROM obs LEFT JOIN done ON done.series = obs.series AND done.us = obs.us""",
    "inflow_stream": f"""WITH RECURSIVE {_REVISED} SELECT x.series, x.us, 'filtered' AS kind, round(m1, 4) AS value, {_FLAG} AS prediction_flag, 'NON_SMOOTHED' AS smoothing_flag FROM rec x
UNION ALL SELECT x.series, x.us, 'revised', round(s1, 4), {_FLAG}, 'SMOOTHED' FROM rec x JOIN back b ON b.series = x.series AND b.k = x.n AND b.j = b.k""",
    "calibration_warnings": f"WITH RECURSIVE {_COUNTED}, pooled AS ({_POOLED}), each AS (" + " UNION ALL ".join(f"SELECT series, '{m}' AS metric, {m} AS value, CAST({low!r} AS DOUBLE) AS low, CAST({high!r} AS DOUBLE) AS high FROM pooled" for m, low, high in _CHECKS) + ") SELECT series, metric, round(value, 4) AS value, round(low, 4) AS low, round(high, 4) AS high FROM each WHERE value IS NULL OR value < low OR value > high",
    "noise_screening": " UNION ALL ".join(_screened(k, q, r) for k, (q, r) in enumerate(((Q, R), ((1e-4, 1e-3, 1e-4), (0.25, 4.0)), ((1e-4, 2e-5, 1e-4), (0.5, 4.0))))),
    "innovation_autocorrelation": f"""WITH RECURSIVE {_SCORES}, m AS (SELECT series, us, storage_z - avg(storage_z) OVER (PARTITION BY series) AS x FROM rows_ WHERE storage_z IS NOT NULL), l AS (SELECT CAST(i AS BIGINT) * {DAY_US // 2} AS lag_us FROM range(1, 9) t(i)),
pr AS (SELECT a.series, lag_us, a.x AS x0, b.x AS x1 FROM m a, l, m b WHERE a.series = b.series AND b.us > a.us AND abs(b.us - a.us - lag_us) <= {DAY_US // 8}), bins AS (SELECT series, lag_us, sum(x0 * x1) / sqrt(sum(x0 * x0) * sum(x1 * x1)) AS ac FROM pr GROUP BY 1, 2 HAVING count(*) >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(ac) DESC, lag_us) AS rn FROM bins) SELECT series, round(abs(ac), 5) AS largest, lag_us FROM o WHERE rn = 1""",
    "observations": f"WITH {oracle.OBS} SELECT * FROM obs",
    "order_faults": "SELECT event_type AS series, epoch_us(ts) // 600000000 * 600000000 AS us, 'repeated' AS fault FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "filter_steps": f"WITH {oracle.OBS}, {oracle.STEPS} SELECT series, us, storage, outflow, round(dt, 6) AS dt, first_us, second_us FROM steps",
    "model_steps": f"WITH {oracle.OBS}, {oracle.STEPS}, m AS (SELECT series, us, {FACTOR} * dt AS volume_per_flow, 1e-4 * dt + {FACTOR} * {FACTOR} * 3e-4 * dt * dt * dt / 3 AS q00, {FACTOR} * 2e-4 * dt * dt / 2 AS q01, -({FACTOR} * 1e-4 * dt * dt / 2) AS q02, 2e-4 * dt AS q11, 1e-4 * dt AS q22 FROM steps WHERE dt IS NOT NULL) SELECT series, us, {_r('volume_per_flow q00 q01 q02 q11 q22')} FROM m",
    "inflow_filtered": f"WITH RECURSIVE {_FILTER} SELECT series, us, round(m0, 5) AS storage_state, round(m1, 5) AS estimated_inflow, round(m2, 5) AS outflow_state, round(sqrt(p11), 5) AS deviation, CASE WHEN storage IS NOT NULL AND outflow IS NOT NULL THEN 'NORMAL' ELSE 'PREDICTED' END AS flag FROM rec",
    "filter_in_spans": f"WITH RECURSIVE {_FILTER} SELECT series, us, round(m1, 5) AS estimated_inflow FROM rec",
    "inflow_revised": f"WITH RECURSIVE {oracle.smooth_sql(_FILTER, _LAG, FACTOR)} SELECT b.series, x.us, round(s0, 4) AS storage_state, round(s1, 4) AS revised_inflow, round(s2, 4) AS outflow_state FROM back b JOIN rec x ON x.series = b.series AND x.n = b.k WHERE b.j = b.k",
    "inflow_log_likelihood": f"WITH RECURSIVE {_SCORES} SELECT series, round(sum(-joint_nlpd), 4) AS log_likelihood, count(*) AS steps FROM rows_ GROUP BY series",
    "release_times": f"WITH {oracle.OBS} SELECT series, us, min(us) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN {_LAG} FOLLOWING AND UNBOUNDED FOLLOWING) AS release_us FROM obs",
    "active_counts": f"WITH {oracle.OBS} SELECT series, us, count(*) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN {_LAG - 1} PRECEDING AND CURRENT ROW) AS active FROM obs",
    "validation_windows": f"WITH {oracle.OBS}, {_NT % (6, 'WHERE storage IS NOT NULL')} SELECT *, round(n / sum(n) OVER (PARTITION BY series), 6) AS weight FROM windows",
    "window_faults": f"WITH {oracle.OBS}, {_NT % (4, '')}, odd AS (SELECT series, name, CASE WHEN name = 'window-3' THEN start_us - 1 ELSE start_us END AS start_us, end_us FROM windows), b AS (SELECT *, max(end_us) OVER (PARTITION BY series ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM odd) SELECT series, name, 'overlap' AS fault FROM b WHERE before > start_us",
    "window_capacity": f"WITH {oracle.OBS}, {oracle.STEPS}, {_NT % (6, '')} SELECT w.series, w.name, coalesce(sum(CASE WHEN s.us > second_us AND s.us >= second_us + {_LAG} AND storage IS NOT NULL THEN 1 ELSE 0 END), 0)::BIGINT AS scorable, scorable >= 5 AS enough FROM windows w LEFT JOIN steps s ON s.series = w.series AND s.us >= w.start_us AND s.us < w.end_us GROUP BY 1, 2".replace("FROM (SELECT DISTINCT series, us FROM obs )", "FROM (SELECT DISTINCT series, us FROM obs)"),
    "row_scores": f"WITH RECURSIVE {_SCORES} SELECT series, us, joint_components, {_r('joint_nlpd joint_nis storage_nlpd storage_z outflow_z conditional_storage_z', 5)} FROM rows_",
    "window_scores": f"WITH RECURSIVE {_WINDOW_SCORES} SELECT wins.series, wins.name, start_us, end_us, coalesce(storage_count, 0) AS storage_count, coalesce(joint_count, 0) AS joint_count, {_r('storage_nlpd joint_nlpd joint_nis storage_nis outflow_nis conditional_storage_nis storage_bias outflow_bias conditional_storage_bias', 5)}, round(coalesce(scored_fraction, 0), 5) AS scored_fraction FROM wins LEFT JOIN agg USING (series, name)",
    "pooled_metrics": f"WITH RECURSIVE {_COUNTED} SELECT series, round(avg(CAST(m1 < 0 AS INT)), 5) AS negative_inflow_frequency, round(avg(storage_z), 5) AS storage_bias, round(avg(outflow_z), 5) AS outflow_bias, round(avg(conditional_storage_z), 5) AS conditional_storage_bias, round(sum(joint_nis) / sum(CASE WHEN joint_nis IS NOT NULL THEN joint_components END), 5) AS joint_nis, round(avg(storage_z * storage_z), 5) AS storage_nis, round(avg(outflow_z * outflow_z), 5) AS outflow_nis, round(avg(conditional_storage_z * conditional_storage_z), 5) AS conditional_storage_nis, round(var_samp(storage_z * storage_z), 5) AS storage_nis_variance, round(var_samp(outflow_z * outflow_z), 5) AS outflow_nis_variance, round(avg(CAST(abs(storage_z) <= 0.6744897501960817 AS INT)), 5) AS storage_coverage_50, round(avg(CAST(abs(storage_z) <= 1.6448536269514722 AS INT)), 5) AS storage_coverage_90, round(avg(CAST(abs(outflow_z) <= 0.6744897501960817 AS INT)), 5) AS outflow_coverage_50, round(avg(CAST(abs(outflow_z) <= 1.6448536269514722 AS INT)), 5) AS outflow_coverage_90, round(sqrt(avg(CASE WHEN storage_z IS NOT NULL THEN v0 * v0 END)), 5) AS causal_storage_prediction_rmse, round(avg(CASE WHEN storage_z IS NOT NULL THEN v0 END), 5) AS causal_storage_prediction_bias FROM inside GROUP BY series",
    "inflow_changes": f"WITH RECURSIVE {_COUNTED}, ch AS (SELECT series, (m1 - lag(m1) OVER w) / ((us - lag(us) OVER w) / 1e6) AS change FROM inside WINDOW w AS (PARTITION BY series ORDER BY us)) SELECT series, round(median(change) * 1e6, 3) AS median, round(quantile_cont(abs(change), 0.95) * 1e6, 3) AS q95 FROM ch GROUP BY series",
    "candidate_validity": f"WITH RECURSIVE {_WINDOW_SCORES}, r AS (SELECT wins.series, unnest([x FOR x IN [CASE WHEN coalesce(storage_count, 0) < 8 THEN wins.name || ' has fewer than 8 scored storage readings' END, CASE WHEN joint_nlpd IS NULL THEN wins.name || ' has no finite joint density' END, ''] IF x IS NOT NULL]) AS reason FROM wins LEFT JOIN agg USING (series, name)) SELECT series, coalesce(string_agg(CASE WHEN reason <> '' THEN reason END, '; ' ORDER BY reason), '') AS reasons, count(CASE WHEN reason <> '' THEN 1 END) = 0 AS valid FROM r GROUP BY series",
    "autocorrelation": f"WITH {oracle.OBS}, m AS (SELECT series, us, outflow - avg(outflow) OVER (PARTITION BY series) AS x FROM obs WHERE outflow IS NOT NULL), l AS (SELECT CAST(i AS BIGINT) * {DAY_US // 2} AS lag_us FROM range(1, 9) t(i)), pr AS (SELECT a.series, lag_us, a.x AS x0, b.x AS x1 FROM m a, l, m b WHERE a.series = b.series AND b.us > a.us AND abs(b.us - a.us - lag_us) <= {DAY_US // 8}), g AS (SELECT series, lag_us, count(*) AS n, sum(x0 * x1) AS c, sum(x0 * x0) AS e0, sum(x1 * x1) AS e1 FROM pr GROUP BY 1, 2) SELECT k.series, k.lag_us, round(CASE WHEN n >= 3 AND sqrt(e0 * e1) > 0 THEN c / sqrt(e0 * e1) END, 6) AS autocorrelation, coalesce(n, 0) AS pair_count FROM (SELECT * FROM (SELECT DISTINCT series FROM m), l) k LEFT JOIN g USING (series, lag_us)",
    "reading_noise_table": f"""WITH {_EVEN}, t AS (SELECT series, us, storage - lag(storage) OVER w AS later, lag(storage) OVER w - lag(storage, 2) OVER w AS earlier, lag(us) OVER w AS us1, lag(us, 2) OVER w AS us0, min(us) OVER (PARTITION BY series) AS origin FROM even WINDOW w AS (PARTITION BY series ORDER BY us)),
pairs AS (SELECT *, (us - origin) // 604800000000 AS week FROM t WHERE us - us1 = us1 - us0), win AS (SELECT 'first' AS win, {START_US} AS a, {START_US + 15 * DAY_US} AS b UNION ALL SELECT 'second', {START_US + 15 * DAY_US}, {START_US + 30 * DAY_US}),
named AS (SELECT pairs.*, win FROM pairs JOIN win ON us0 >= a AND us < b UNION ALL SELECT pairs.*, 'all' FROM pairs WHERE us0 >= {START_US} AND us < {START_US + 30 * DAY_US}),
mm AS (SELECT *, (avg(later) OVER g + avg(earlier) OVER g) / 2 AS m FROM named WINDOW g AS (PARTITION BY series, win, week)),
weeks AS (SELECT series, win, week, count(*) AS n, -avg((later - m) * (earlier - m)) AS e, sum(CASE WHEN later = 0 THEN 1 ELSE 0 END) AS still FROM mm GROUP BY 1, 2, 3),
f AS (SELECT series, win, sum(n) AS pairs, count(CASE WHEN n >= 20 THEN 1 END) AS blocks, median(CASE WHEN n >= 20 THEN e END) AS middle, sum(still) / sum(n) AS share FROM weeks GROUP BY 1, 2)
SELECT k.series, k.win AS "window", round(CASE WHEN pairs >= 100 AND blocks > 0 THEN greatest(middle, 0) END, 3) AS r_storage, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CASE WHEN pairs >= 100 THEN blocks ELSE 0 END AS blocks, round(CASE WHEN pairs >= 100 AND blocks > 0 THEN share END, 3) AS unchanged_share
FROM (SELECT * FROM (SELECT DISTINCT series FROM even), (SELECT unnest(['first', 'second', 'all']) AS win)) k LEFT JOIN f USING (series, win)""",
    "reading_noise_warnings": "",
    "clean_sources": f"WITH {CLEAN_SQL} SELECT * FROM series",
    "source_audit": f"""WITH {CLEAN_SQL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY name ORDER BY us) AS gap FROM series),
own AS (SELECT name, count(*) AS clean_rows, avg(CAST(value IS NOT NULL AS INT)) AS frac, min(us) AS first_us, max(us) AS last_us, median(gap) / 60e6 AS med, count(CASE WHEN gap > 1200000000 THEN 1 END) AS gaps FROM g GROUP BY name),
r AS (SELECT name, count(*) AS source_rows, count(CASE WHEN us IS NULL THEN 1 END) AS bad FROM raw GROUP BY name)
SELECT name, source_rows, clean_rows, bad AS timestamp_parse_failures, source_rows - bad - clean_rows AS duplicates_removed, round(frac, 6) AS finite_value_fraction, first_us, last_us, round(med, 6) AS median_interval_min, gaps AS gaps_over_20min FROM r JOIN own USING (name)""",
    "exported_sources": f"WITH {CLEAN_SQL} SELECT * FROM series",
    "exported_audit": f"""SELECT *, name AS identifier, 'here' AS location, 'ft' AS units FROM (WITH {CLEAN_SQL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY name ORDER BY us) AS gap FROM series),
own AS (SELECT name, count(*) AS clean_rows, avg(CAST(value IS NOT NULL AS INT)) AS frac, min(us) AS first_us, max(us) AS last_us, median(gap) / 60e6 AS med, count(CASE WHEN gap > 1200000000 THEN 1 END) AS gaps FROM g GROUP BY name),
r AS (SELECT name, count(*) AS source_rows, count(CASE WHEN us IS NULL THEN 1 END) AS bad FROM raw GROUP BY name)
SELECT name, source_rows, clean_rows, bad AS timestamp_parse_failures, source_rows - bad - clean_rows AS duplicates_removed, round(frac, 6) AS finite_value_fraction, first_us, last_us, round(med, 6) AS median_interval_min, gaps AS gaps_over_20min FROM r JOIN own USING (name))""",
    "inflow_smoothed_whole": f"WITH RECURSIVE {oracle.whole_sql(_FILTER, FACTOR)} SELECT w.series, x.us, round(s1, 4) AS smoothed_inflow, round(sqrt(v11), 4) AS deviation FROM whole w JOIN rec x USING (series, n)",
    "smoothed_in_spans": f"WITH RECURSIVE {oracle.whole_sql(_FILTER, FACTOR)} SELECT w.series, x.us, round(s1, 4) AS smoothed_inflow FROM whole w JOIN rec x USING (series, n)",
    "inflow_provisional": f"""WITH RECURSIVE {oracle.whole_sql(_REVISED, FACTOR)}, done AS (SELECT x.series, x.us, coalesce(b.s1, w.s1) AS s1, CASE WHEN b.k IS NOT NULL THEN {_FLAG} END AS flag, b.k IS NOT NULL AS released FROM rec x JOIN whole w USING (series, n) LEFT JOIN (SELECT * FROM back WHERE j = k) b ON b.series = x.series AND b.k = x.n)
SELECT o.series, o.us, round(s1, 4) AS revised_inflow, flag AS revised_inflow_flag, CASE WHEN released THEN 'SMOOTHED' ELSE 'NON_SMOOTHED' END AS revised_inflow_smoothing_flag FROM obs o LEFT JOIN done d ON d.series = o.series AND d.us = o.us""",
    "inflow_intervals": f"""WITH RECURSIVE {oracle.smooth_sql(_FILTER, _LAG, FACTOR, covariances=True)}, done AS (SELECT x.series, x.us, x.m1, sqrt(x.p11) AS d0, s1, sqrt(v11) AS d1, {_FLAG} AS flag, b.k IS NOT NULL AS released FROM rec x LEFT JOIN (SELECT * FROM back WHERE j = k) b ON b.series = x.series AND b.k = x.n)
SELECT o.*, round(m1, 4) AS estimated_inflow, round(s1, 4) AS revised_inflow, flag AS estimated_inflow_flag, CASE WHEN released THEN flag END AS revised_inflow_flag, 'NON_SMOOTHED' AS estimated_inflow_smoothing_flag, CASE WHEN released THEN 'SMOOTHED' ELSE 'NON_SMOOTHED' END AS revised_inflow_smoothing_flag,
  round(d0, 4) AS estimated_inflow_standard_deviation, round(d1, 4) AS revised_inflow_standard_deviation, round(m1 - {_Z95} * d0, 4) AS estimated_inflow_lower, round(m1 + {_Z95} * d0, 4) AS estimated_inflow_upper, round(s1 - {_Z95} * d1, 4) AS revised_inflow_lower, round(s1 + {_Z95} * d1, 4) AS revised_inflow_upper FROM obs o LEFT JOIN done d ON d.series = o.series AND d.us = o.us""",
    "stream_rejected": f"WITH {oracle.OBS} SELECT series, us, 'rejected' AS kind FROM obs WHERE us // 1000000 % 7 = 0",
    "cadence_autocorrelation": f"""WITH {_EVEN}, gaps AS (SELECT series, min(gap) AS gap FROM (SELECT series, us - lag(us) OVER (PARTITION BY series ORDER BY us) AS gap FROM even) GROUP BY series), m AS (SELECT series, us, storage - avg(storage) OVER (PARTITION BY series) AS x FROM even WHERE storage IS NOT NULL),
l AS (SELECT series, unnest(generate_series(gap, {DAY_US} + (gap + 1) // 2 - 1, gap)) AS lag_us, greatest(gap // 4, 1000000) AS tol FROM gaps), pr AS (SELECT a.series, lag_us, a.x AS x0, b.x AS x1 FROM m a JOIN l USING (series) JOIN m b ON a.series = b.series AND b.us > a.us AND b.us BETWEEN a.us + lag_us - tol AND a.us + lag_us + tol),
g AS (SELECT series, lag_us, count(*) AS n, sum(x0 * x1) AS c, sum(x0 * x0) AS e0, sum(x1 * x1) AS e1 FROM pr GROUP BY 1, 2) SELECT l.series, l.lag_us, round(CASE WHEN n >= 3 AND sqrt(e0 * e1) > 0 THEN c / sqrt(e0 * e1) END, 5) AS autocorrelation, coalesce(n, 0) AS pair_count FROM l LEFT JOIN g USING (series, lag_us)""",
    "positional_lags": f"""WITH {oracle.OBS}, pr AS (""" + " UNION ALL ".join(f"SELECT series, {k} AS lag, outflow AS x, lag(storage, {k}) OVER (PARTITION BY series ORDER BY us) AS y FROM obs" for k in range(-3, 4)) + """), both_ AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS ok FROM pr)
SELECT series, lag, round(CASE WHEN count(CASE WHEN ok THEN 1 END) >= 2 AND least(stddev_pop(CASE WHEN ok THEN x END), stddev_pop(CASE WHEN ok THEN y END)) > 2.220446049250313e-16 THEN covar_pop(CASE WHEN ok THEN x END, CASE WHEN ok THEN y END) / (stddev_pop(CASE WHEN ok THEN x END) * stddev_pop(CASE WHEN ok THEN y END)) END, 5) AS correlation, count(CASE WHEN ok THEN 1 END) AS pair_count FROM both_ GROUP BY series, lag""",
    "frame_faults": """WITH o AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 20 AS VARCHAR) AS series, epoch_us(ts) // 600000000 * 600000000 AS us, CASE WHEN event_id % 5 <> 0 THEN value END AS storage FROM events)
SELECT series, us, 'repeated' AS fault FROM o GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT series, NULL AS us, 'too few storage readings' AS fault FROM o GROUP BY 1 HAVING count(storage) < 2""",
    "noise_units": "SELECT event_id, round(sqrt(abs(value) * 3600), 5) AS hourly_sd FROM events WHERE value IS NOT NULL",
    "asof_aligned": f"WITH {_ASOF} SELECT series, us, storage, outlet, spillway, upstream FROM aligned",
    "combined_outflow": f"WITH {_COMBINED} SELECT series, us, storage, round(outflow, 6) AS outflow, spillway_used, spillway_unknown, outflow_definition FROM joint",
    "window_audit": f"""WITH {_COMBINED}, g AS (SELECT *, us - lag(us) OVER (ORDER BY us) AS gap FROM joint) SELECT series, min(us) AS actual_start_us, max(us) AS actual_end_us, count(*) AS rows, count(*) - count(storage) AS storage_missing, count(*) - count(outflow) AS outflow_missing, count(*) - count(upstream) AS upstream_missing, count(CASE WHEN spillway_unknown THEN 1 END) AS spillway_unknown, count(CASE WHEN spillway < 0 THEN 1 END) AS spillway_invalid,
count(CASE WHEN spillway_used THEN 1 END) AS spillway_used, round(median(gap) / 60e6, 6) AS median_interval_min, count(CASE WHEN gap > 1200000000 THEN 1 END) AS intervals_over_20min, max(outflow_definition) AS outflow_definition FROM g GROUP BY series""",
    "outer_aligned": f"WITH {CLEAN_SQL} SELECT 'all' AS series, coalesce(a.us, b.us) AS us, a.value AS estimate, b.value AS upstream FROM (SELECT * FROM series WHERE name = 'view') a FULL JOIN (SELECT * FROM series WHERE name = 'click') b ON a.us = b.us",
    "shared_times": f"WITH {CLEAN_SQL} SELECT 'all' AS series, a.us, a.value, b.value AS other FROM (SELECT * FROM series WHERE name = 'view') a LEFT JOIN (SELECT * FROM series WHERE name = 'click') b ON a.us = b.us",
    "unmatched_times": f"WITH {CLEAN_SQL} SELECT 'all' AS series, coalesce(a.us, b.us) AS us, CASE WHEN a.us IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT us FROM series WHERE name = 'view') a FULL JOIN (SELECT us FROM series WHERE name = 'click') b ON a.us = b.us WHERE a.us IS NULL OR b.us IS NULL",
    "validation_frame": f"WITH {_COMPARISON} SELECT series, us, {_r('storage outflow raw_inflow centered_rolling_inflow estimated_inflow delayed_revised_inflow upstream_flow')} FROM frame",
    "proxy_agreement": f"""WITH {_COMPARISON}, sz AS (SELECT series, estimate, count(*) AS cand FROM est GROUP BY 1, 2), pr AS (SELECT *, value - upstream_flow AS err FROM est WHERE value IS NOT NULL AND upstream_flow IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY series, estimate ORDER BY value) + (count(*) OVER (PARTITION BY series, estimate, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY series, estimate ORDER BY upstream_flow) + (count(*) OVER (PARTITION BY series, estimate, upstream_flow) - 1) / 2 AS ry FROM pr),
a AS (SELECT series, estimate, count(*) AS n, corr(value, upstream_flow) AS r, corr(rx, ry) AS rho, stddev_samp(value) / stddev_samp(upstream_flow) AS vr, avg(value) / avg(upstream_flow) AS mr, sum(err) / sum(upstream_flow) * 100 AS pb, 1 - sum(err * err) / (var_pop(upstream_flow) * count(*)) AS nse, sqrt(avg(err * err)) / abs(avg(upstream_flow)) AS nr FROM rk GROUP BY 1, 2)
SELECT series, estimate, coalesce(n, 0) AS paired_observations, round(coalesce(n, 0) / cand, 5) AS coverage, round(r, 5) AS pearson_correlation, round(r, 5) AS kge_correlation, round(rho, 5) AS spearman_correlation, round(vr, 5) AS kge_variability_ratio, round(mr, 5) AS kge_mean_flow_ratio, round(1 - sqrt((r - 1) * (r - 1) + (vr - 1) * (vr - 1) + (mr - 1) * (mr - 1)), 5) AS kge, round(pb, 5) AS percent_bias, round(nse, 5) AS nse, round(nr, 5) AS normalized_rmse FROM sz LEFT JOIN a USING (series, estimate)""",
    "lag_curve": f"WITH {_COMPARISON}, {_curve('est', 'cv')} SELECT series, estimate, lag_hours, round(correlation, 5) AS correlation, paired_observations FROM cv",
    "best_lags": f"WITH {_COMPARISON}, {_curve('est', 'cv')} SELECT series, estimate, round(zero, 5) AS zero_lag_pearson_correlation, round(top, 5) AS max_correlation, lag AS best_lag_hours, n AS paired_observations_at_best_lag, round(top - zero, 5) AS improvement_over_zero_lag FROM cv_lags",
    "frozen_lags": f"""WITH {_COMPARISON}, tr AS (SELECT * FROM est WHERE us <= {START_US + 15 * DAY_US}), ev AS (SELECT * FROM est WHERE us >= {START_US + 15 * DAY_US + 3_600_000_000}), {_curve('tr', 'ct')}, {_curve('ev', 'cv')}
SELECT v.series, v.estimate, round(v.zero, 5) AS zero_lag_pearson_correlation, round(CASE WHEN t.lag IS NOT NULL THEN c.correlation ELSE v.top END, 5) AS max_correlation, coalesce(t.lag, v.lag) AS best_lag_hours, CASE WHEN t.lag IS NOT NULL THEN c.paired_observations ELSE v.n END AS paired_observations_at_best_lag,
round(CASE WHEN t.lag IS NOT NULL THEN c.correlation ELSE v.top END - v.zero, 5) AS improvement_over_zero_lag, CASE WHEN t.lag IS NOT NULL THEN 'training (frozen for evaluation)' ELSE 'evaluation' END AS lag_selection FROM cv_lags v LEFT JOIN ct_lags t USING (series, estimate) LEFT JOIN cv c ON c.series = v.series AND c.estimate = v.estimate AND c.lag_hours = t.lag""",
    "storage_closure": f"""WITH {_COMPARISON}, x AS (SELECT series, estimate, (us - lag(us) OVER w) / 1e6 AS dt, (lag(value) OVER w - lag(outflow) OVER w) * ((us - lag(us) OVER w) / 1e6) * {FACTOR} - (storage - lag(storage) OVER w) AS err FROM est WINDOW w AS (PARTITION BY series, estimate ORDER BY us)), y AS (SELECT *, err / (dt * {FACTOR}) AS fe FROM x)
SELECT series, estimate, count(err) AS paired_observations, round(count(err) / (count(*) - 1), 4) AS coverage, round(sqrt(avg(err * err)), 4) AS rmse, round(avg(abs(err)), 4) AS mae, round(avg(err), 4) AS bias, round(sqrt(avg(fe * fe)), 4) AS rmse_cfs, round(avg(abs(fe)), 4) AS mae_cfs, round(avg(fe), 4) AS bias_cfs FROM y GROUP BY 1, 2""",
    "inflow_behavior": f"""WITH {_COMPARISON}, x AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series, estimate ORDER BY us)) AS ch FROM est)
SELECT series, estimate, count(value) AS finite_observations, round(avg(CAST(value < 0 AS INT)) * 100, 5) AS negative_hour_frequency_percent, round(avg(CASE WHEN value < 0 THEN -value END), 5) AS mean_negative_inflow_cfs, round(avg(ch), 5) AS mean_absolute_hourly_change_cfs FROM x GROUP BY 1, 2""",
    "unit_conversions": f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events), b AS (SELECT *, (us - lag(us) OVER (PARTITION BY series ORDER BY us)) / 1e6 AS s FROM a WHERE rn = 1)
SELECT series, us, round(value * s * {FACTOR}, 5) AS volume, round(value / (s * {FACTOR}), 5) AS flow, round(value * (CAST(43560 AS DOUBLE) * pow(CAST(0.3048 AS DOUBLE), 3)), 5) AS cubic_metres, round(value * pow(CAST(0.3048 AS DOUBLE), 3), 5) AS cubic_metres_per_second, true AS valid FROM b""",
}
ORACLE_SQL["reading_noise_warnings"] = f"""WITH t AS ({ORACLE_SQL["reading_noise_table"]}), sp AS (SELECT series, arg_min("window", r_storage) AS low, arg_max("window", r_storage) AS high, max(r_storage) / min(r_storage) AS times, count(*) AS n FROM t WHERE "window" <> 'all' AND r_storage > 0 GROUP BY series)
SELECT series, 'no estimate: too few evenly spaced pairs' AS warning FROM t WHERE "window" = 'all' AND r_storage IS NULL
UNION ALL SELECT series, 'no estimate: changes are not negatively correlated' FROM t WHERE "window" = 'all' AND r_storage = 0
UNION ALL SELECT series, "window" || ' gave no estimate' FROM t WHERE "window" <> 'all' AND r_storage = 0
UNION ALL SELECT series, 'reading noise differs between ' || low || ' and ' || high FROM sp WHERE n > 1 AND times > 4"""
