"""The whole way from a reservoir's exports to a proposed configuration and its report."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import asof, combined_outflow, from_first_joint, window_audit
from ..operators.prepare import checked_frame, observations, split_windows, steps, window_capacity
from ..sources.gauges import Sources, clean, read_sources, source_audit, write_report
from ..sources.shared import shared_dir, staged
from .config import ScoreSettings, SeriesConfig, Window
from .tuning import TuningError, TuningSettings, tune

#: Rows of a table that stand in the report itself; a larger table is written whole beside it.
REPORT_ROWS = 10_000


def prepared(spark: SparkSession, sources: Sources, start_us: int, end_us: int, tolerance_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, source audit, window audit) of a reservoir's exports: storage's clock in [start_us, end_us] with outflow and upstream, from the first joint reading on."""
    paths = {"storage": sources.storage, "outlet": sources.outlet, "upstream": sources.upstream}
    if sources.spillway:
        paths["spillway"] = sources.spillway
    raw, heads = read_sources(spark, paths)
    raw = staged(raw, "exports")
    rows = staged(clean(raw).withColumn("series", F.lit(sources.name)), "clean")
    clock = rows.filter("name = 'storage'").select("series", "us", F.col("value").alias("storage"))
    aligned = asof(clock, rows.filter("name <> 'storage'").select("series", F.col("name").alias("source"), "us", "value"), tolerance_us)
    for name in ("outlet", "spillway", "upstream"):
        if name not in aligned.columns:
            aligned = aligned.withColumn(name, F.lit(None).cast("double"))
    joint = staged(from_first_joint(combined_outflow(aligned, start_us, end_us)), "joint")
    return joint, source_audit(raw, headers=heads), window_audit(joint, requested=(start_us, end_us, tolerance_us))


def equal_windows(obs: DataFrame, count: int, settings: ScoreSettings) -> list[Window]:
    """`count` windows of equal numbers of rows over the times of one series; one without enough storage readings to score is an error."""
    found = split_windows(obs, count)
    short = window_capacity(steps(obs), found, int(settings.warmup.total_seconds() * 1e6), settings.least_scored).filter("NOT enough").orderBy("name").head(1)
    if short:
        raise ValueError(f"{short[0]['name']} has only {short[0].scorable} storage readings to score")
    return [Window(r.name, r.start_us, r.end_us) for r in found.orderBy("start_us").collect()]


def tune_exports(
    spark: SparkSession, sources: Sources, base: SeriesConfig, start_us: int, end_us: int, config_path: str, version: str, report_path: str | None = None, windows: int = 6, tolerance_us: int = 1_200_000_000,
    settings: ScoreSettings | None = None, tuning: TuningSettings | None = None, seeds: list[float] | None = None, progress: Callable[[str, int], None] | None = None,
) -> dict:
    """Reads the exports, tunes over equal windows with the upstream flow as proxy, and writes the proposed configuration (and a report) as JSON.

    One reservoir is one series. Paths are local or URIs. Returns what tune returns, with the audits.
    """
    if end_us < start_us:
        raise ValueError("the end lies before the start")
    if report_path is not None and report_path == config_path:
        raise ValueError("the report would overwrite the configuration")
    settings = settings or ScoreSettings()
    rows, audit, window = prepared(spark, sources, start_us, end_us, tolerance_us)
    obs = staged(checked_frame(observations(rows, "series", "us", "storage", "outflow")), "observations")
    if windows < 3:
        raise TuningError("tuning needs three windows or more")
    proxy = rows.select("series", "us", F.col("upstream").alias("proxy"))
    out = tune(obs, base, equal_windows(obs, windows, settings), settings, tuning, progress, proxy=proxy, seeds=seeds, version=version)
    store, place = fs.FileSystem.from_uri(config_path) if "://" in config_path else (fs.LocalFileSystem(), config_path)
    with store.open_output_stream(place) as f:
        f.write((out["config"].as_json() + "\n").encode())
    out |= {"source_audit": audit, "window_audit": window}
    if report_path is not None:
        write_report(report_path, {k: _plain_table(v, _beside(spark, report_path, k)) for k, v in out.items() if k != "config"} | {"version": version}, config_path)
    return out


def _beside(spark: SparkSession, report_path: str, name: str) -> str:
    """Where a report's large table goes: beside a report in a store, else to the shared folder, as executors don't see the driver's disk."""
    base = report_path if "://" in report_path else f"{shared_dir(spark)}/{os.path.basename(report_path)}"
    return f"{base}.tables/{name}"


def _plain_table(value, path: str, most: int = REPORT_ROWS):
    """A DataFrame of up to `most` rows as a list of them; a larger one is written whole as Parquet to path, in parallel, and gives its number of rows and the path; scored rows give their number; anything else stays as it is."""
    if not isinstance(value, DataFrame):
        return value
    total = value.count()
    if "us" in value.columns:
        return {"rows": total}
    if total > most:
        value.write.mode("overwrite").parquet(path)
        return {"rows": total, "path": path}
    return [r.asDict(recursive=True) for r in value.collect()]
