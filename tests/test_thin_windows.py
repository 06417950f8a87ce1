"""Series with windows that hold few readings or none, among others."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three users with events each eight hours; in the second ten days the second's are all errors, and the third has only two that aren't."""
    rows = []
    for user in range(3):
        for i in range(90):
            day = i / 3
            bare = 10 <= day < 20 and (user == 1 or (user == 2 and i not in (40, 50)))
            kind = "error" if bare else ("view", "purchase", "signup", "click")[(i * 7 + user) % 4]
            rows.append((1000 * user + i, START + timedelta(hours=8 * i, minutes=user), user, kind, 50.0 + (i * 37 + user * 11) % 23))
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def by_sql(name, folder):
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{folder}/events.parquet/*.parquet')")
        return sorted(c.execute(entry.oracle_sql()[name]).fetchall())


def test_gains_where_a_window_has_no_reading(spark, events):
    got = sorted(tuple(r) for r in entry.queries()["candidate_gain"](spark, events).select("series", "gain", "error", "windows").collect())
    assert got == by_sql("candidate_gain", events) and [r[3] for r in got] == [3, 2, 3]


def test_terms_are_determined_though_a_series_has_thin_windows(spark, events):
    got = sorted(tuple(r) for r in entry.queries()["identifiability"](spark, events).select("term", "standard_error", "correlation").collect())
    assert len(got) == 2 and got == by_sql("identifiability", events)
