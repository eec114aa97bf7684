"""Queries over small tables made for one case, against their SQL in DuckDB."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def events(tmp_path):
    """Write rows (seconds after BASE, user, type, value) as a table of events; numbered by step; gives its folder."""

    def write(rows, step=1):
        c = duckdb.connect()
        c.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
        c.executemany("insert into e values (?, ?, ?, ?, ?, ?)", [(step * i, BASE + dt.timedelta(seconds=at), user, kind, value, '{"k": 1}') for i, (at, user, kind, value) in enumerate(rows)])
        c.execute(f"copy e to '{tmp_path}/events.parquet'")
        return str(tmp_path)

    return write


def by_sql(name: str, d: str) -> list[tuple]:
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{d}/events.parquet'")
    return sorted(c.execute(entry.oracle_sql()[name]).fetchall())


def by_spark(spark, name: str, d: str) -> list[tuple]:
    return sorted(map(tuple, entry.queries()[name](spark, d).collect()))


def test_rates_are_rounded_as_doubles(spark, events):
    d = events([(1, 1, "a", 100.0), (2, 1, "a", 150.0), (3, 1, "a", 200.0), (4, 1, "a", 250.0)])
    found = by_spark(spark, "R10_funding_on_change", d)
    assert found == by_sql("R10_funding_on_change", d)
    assert [round(r * 10_000) for _, _, r in found] == [1, 2, 3]


def test_deletions_of_every_symbol_are_counted(spark, events):
    d = events([(60 * i, 1, kind, 1.0) for i in range(1790, 1810) for kind in ("a", "view")] + [(60 * 1900, 1, "c", 1.0)])
    found = by_spark(spark, "M3_deleted_count", d)
    assert found == by_sql("M3_deleted_count", d) == [("test", "a", 9), ("test", "c", 0), ("test", "view", 9)]


def test_late_rows_of_long_tables_are_kept(spark, events):
    """Rows over 80 days: those that come late lie more than 60 days behind the newest."""
    d = events([(i, 1, "a", 1.0 + i) for i in range(1000)], 7001)
    found = by_spark(spark, "R2_R3_ordered_minutes", d)
    assert len(found) == len(by_sql("R2_R3_ordered_minutes", d)) and sum(r[-1] for r in found) > 90
