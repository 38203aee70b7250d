import datetime

import duckdb
import pytest

from ostinato.operators import tracks as t
from ostinato.plans import registry
from tests.oracle import connect, rows_of, rows_of_sql

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, data, con, name):
    assert rows_of(registry.queries()[name](spark, data)) == rows_of_sql(con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["onset_band_match", "local_lateness", "seen_falling", "frame_interval_tiles", "as_of_section"])
def test_range_joins_have_no_nested_loop(spark, data, name):
    df = registry.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_and_registry_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def with_events(folder, rows):
    """A folder whose events are these: (event_id, microseconds after the start, user_id, value)."""
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    start = datetime.datetime(2024, 1, 1)
    con.executemany("insert into e values (?, ?, ?, 'click', ?)", [(k, start + datetime.timedelta(microseconds=at), user, value) for k, at, user, value in rows])
    con.execute(f"copy e to '{folder}/events.parquet' (format parquet)")
    return str(folder), connect(str(folder))


def test_errors_count_every_competing_candidate(spark, tmp_path):
    # four notes of one pitch 0.02 s apart: each has several estimates within the tolerance
    folder, con = with_events(tmp_path, [(24 * k + 1, 36_000_000_000 + 720_000_000 * k, 3, 40.0 + k) for k in range(4)])
    got = rows_of(registry.queries()["clip_errors"](spark, folder))
    assert got == rows_of_sql(con, registry.oracle_sql()["clip_errors"])
    assert got[1][0][got[0].index("matched")] > 4


def test_written_values_meet_where_onsets_are_halves_of_a_millionth(spark, tmp_path):
    # a millionth of a second is 36 ms of event time: onsets at its halves, and those that the written value's offset puts there
    at = [36_000 * (9_973 * k + 11) + part for k in range(400) for part in (18_000, 14_400)]
    folder, con = with_events(tmp_path, [(2 * k, t, k, 30.0) for k, t in enumerate(at)])
    assert rows_of(registry.queries()["written_lookup"](spark, folder)) == rows_of_sql(con, registry.oracle_sql()["written_lookup"])


@pytest.mark.parametrize("name", ["exposed_spans", "pauses", "scroll_clock", "build_tracks"])
def test_frames_are_never_broadcast(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pictures_of_tiles_that_are_there_twice_are_no_pauses(spark, tmp_path):
    # each note stands there twice, and falls; then a third one falls alone
    rows = [(24 * k + 1, 36_000_000_000 * (k // 2) * 5, 3, 40.0) for k in range(5)]
    folder, con = with_events(tmp_path, rows)
    got = rows_of(registry.queries()["pauses"](spark, folder))
    assert got == rows_of_sql(con, registry.oracle_sql()["pauses"]) and 0 < len(got[1]) < 10


def test_pictures_are_told_by_tenths_of_a_pixel_as_sql_rounds_them(spark, con):
    # just under a half of a tenth as decimals, but not when multiplied by ten
    places = [220.04999999999998, 220.1]
    assert con.execute("select round(?::double, 1) = round(?::double, 1)", places).fetchone()[0]
    tiles = spark.createDataFrame([(1, k, k / 5, 60, "L", 100.0, y) for k, y in enumerate(places)], "clip_id long, frame long, time double, pitch int, hand string, top double, bottom double")
    assert [tuple(r) for r in t.pauses(tiles, 0.2).collect()] == [(1, 0, 1)]
