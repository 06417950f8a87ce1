"""Gauge exports: CSV files with '#' header lines, their clean series, and audits."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SPAN_US, finite, with_previous
from ..plans.config import plain

TIME, VALUE = "ISO 8601 UTC", "Value"
GAP_US = 20 * 60_000_000


@dataclass(frozen=True)
class Sources:
    """Where a reservoir's files are; spillway may be missing, and is then not added to the outflow."""

    name: str
    storage: str
    outlet: str
    upstream: str
    spillway: str | None = None

    @property
    def combine_spillway(self) -> bool:
        return self.spillway is not None


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def find_sources(spark: SparkSession, catalog: dict[str, dict[str, str]], name: str) -> Sources:
    """The sources of a name in the catalog (any case); a required file that isn't there is an error, a spillway file isn't used."""
    known = {k.casefold(): (k, v) for k, v in catalog.items()}
    if name.casefold() not in known:
        raise ValueError(f"unknown reservoir {name}; known: {', '.join(sorted(catalog))}")
    own, paths = known[name.casefold()]
    for kind in ("storage", "outlet", "upstream"):
        if not exists(spark, paths[kind]):
            raise FileNotFoundError(paths[kind])
    spillway = paths.get("spillway")
    return Sources(own, paths["storage"], paths["outlet"], paths["upstream"], spillway if spillway and exists(spark, spillway) else None)


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, row, time_text, value_text) of an export's data rows, in file order; header lines start with '#'.

    row rises with the place in the file. The columns are found by name; a file without them is an error.
    """
    table = spark.read.option("header", True).option("comment", "#").csv(path)
    if TIME not in table.columns or VALUE not in table.columns:
        raise ValueError(f"{path} lacks a column {TIME} or {VALUE}")
    return table.select(F.lit(name).alias("name"), F.monotonically_increasing_id().alias("row"), F.col(f"`{TIME}`").alias("time_text"), F.col(VALUE).alias("value_text"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the 'key: value' lines that start with '#'."""
    lines = spark.read.text(path).filter("startswith(value, '#') AND contains(value, ':')")
    bare = F.ltrim(F.regexp_replace("value", "^#+", ""))
    return lines.select(F.trim(F.substring_index(bare, ":", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("value"))


# Header keys of an export and the audit's names for them.
HEADER_FIELDS = {"Time-series identifier": "identifier", "Location": "location", "Value units": "units"}


def header_fields(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, path, identifier, location, units) of an export, one row; a line that isn't there is empty, of repeated ones the greatest value counts."""
    lines = read_header(spark, path)
    pick = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")).alias(v) for k, v in HEADER_FIELDS.items()]
    return lines.agg(*pick).select(F.lit(name).alias("name"), F.lit(path).alias("path"), *HEADER_FIELDS.values())


def read_sources(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(readings, headers) of the exports at paths by name: parsed rows (name, row, us, value), and header_fields."""
    rows, heads = None, None
    for name, path in paths.items():
        one, head = parsed(read_export(spark, path, name)), header_fields(spark, path, name)
        rows, heads = (one, head) if rows is None else (rows.unionByName(one), heads.unionByName(head))
    return rows, heads


def parsed(raw: DataFrame) -> DataFrame:
    """raw(name, row, time_text, value_text) with us (null if the time can't be read) and value (null if it isn't a finite number)."""
    ts = F.try_to_timestamp("time_text")
    return raw.select("name", "row", F.unix_micros(ts).alias("us"), finite(F.col("value_text").try_cast("double")).alias("value"))


def clean(rows: DataFrame) -> DataFrame:
    """(name, us, value) of rows(name, row, us, value): one per time, the last in file order; rows without a time are dropped."""
    return rows.filter("us IS NOT NULL").groupBy("name", "us").agg(F.max_by("value", "row").alias("value"))


def source_audit(rows: DataFrame, span: int = SPAN_US, headers: DataFrame | None = None) -> DataFrame:
    """One row per name, with the columns of headers(name, ...) if given: source_rows, clean_rows, timestamp_parse_failures, duplicates_removed, finite_value_fraction, first_us, last_us, median_interval_min, gaps_over_20min."""
    series = with_previous(clean(rows), "name", ["us"], "before", span).withColumn("gap", F.col("us") - F.col("before.us"))
    own = series.groupBy("name").agg(
        F.count("*").alias("clean_rows"),
        F.avg(F.col("value").isNotNull().cast("int")).alias("finite_value_fraction"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        (F.median("gap") / 60e6).alias("median_interval_min"),
        F.count_if(F.col("gap") > GAP_US).alias("gaps_over_20min"),
    )
    raw = rows.groupBy("name").agg(F.count("*").alias("source_rows"), F.count_if(F.col("us").isNull()).alias("timestamp_parse_failures"))
    joined = raw.join(own, "name", "left").withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0)))
    duplicates = F.col("source_rows") - F.col("timestamp_parse_failures") - F.col("clean_rows")
    out = joined.select("name", "source_rows", "clean_rows", "timestamp_parse_failures", duplicates.alias("duplicates_removed"), "finite_value_fraction", "first_us", "last_us", "median_interval_min", "gaps_over_20min")
    return out if headers is None else out.join(headers, "name", "left")


def write_report(path: str, report: dict, config_path: str | None = None) -> None:
    """report as JSON with sorted keys; NaN and infinities become null, time spans seconds. It must not overwrite the configuration.

    path is a local file or a URI (file, hdfs, s3 ...).
    """
    if config_path is not None and path == config_path:
        raise ValueError("the report would overwrite the configuration")
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(place) as f:
        f.write((json.dumps(plain(report), indent=2, sort_keys=True) + "\n").encode())
