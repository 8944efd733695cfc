"""Rollups by day: what a run rewrites, on files."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from deckloom.operators import rollups

SCHEMA = "date date, format_id int, label string, deck_id long, wins int, losses int"
DAYS = [date(2024, 1, k) for k in range(1, 6)]


def rows(extra=()):
    out = [(d, k % 2, f"l{k % 3}", 10 * n + k, k % 4, None if k == 5 else 1) for n, d in enumerate(DAYS) for k in range(6)]
    return out + [(None, 1, "l1", 999, 1, 1)] + list(extra)


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(root, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/{name}") for f in names if f.startswith("part-")}


def now(store, rollup, df):
    return sorted(map(tuple, store.read(rollup, df).collect()), key=str)


def made(rollup, df):
    return sorted(map(tuple, rollup.make(df.where("date is not null")).collect()), key=str)


@pytest.mark.parametrize("rollup", [rollups.SHARES, rollups.RECORDS], ids=lambda r: r.name)
def test_only_changed_days_are_written(spark, tmp_path, rollup):
    store, first = rollups.RollupStore(spark, str(tmp_path)), table(spark, rows())
    assert now(store, rollup, first) == []
    assert store.refresh(rollup, first) == {"written": 5, "emptied": 0, "kept": 0}
    assert now(store, rollup, first) == made(rollup, first)
    before = files(tmp_path, rollup.name)
    assert store.refresh(rollup, first.repartition(3)) == {"written": 0, "emptied": 0, "kept": 5}
    assert files(tmp_path, rollup.name) == before
    # One event more on one day.
    more = table(spark, rows([(DAYS[2], 0, "new", 77, 3, 0)]))
    assert store.refresh(rollup, more) == {"written": 1, "emptied": 0, "kept": 4}
    after = files(tmp_path, rollup.name)
    assert {os.path.dirname(p)[-10:] for p in set(after) ^ set(before)} == {str(DAYS[2])}
    assert now(store, rollup, more) == made(rollup, more)


def test_days_that_lose_their_rows(spark, tmp_path):
    store, first = rollups.RollupStore(spark, str(tmp_path)), table(spark, rows())
    store.refresh(rollups.RECORDS, first)
    left = [r for r in rows() if r[0] != DAYS[0]]
    without = [(*r[:4], None, None) if r[0] == DAYS[1] else r for r in left]
    df = table(spark, without)
    assert store.refresh(rollups.RECORDS, df) == {"written": 1, "emptied": 1, "kept": 3}
    assert now(store, rollups.RECORDS, df) == made(rollups.RECORDS, df) and len({r[-1] for r in now(store, rollups.RECORDS, df)}) == 3
    assert store.refresh(rollups.RECORDS, df.limit(0)) == {"written": 0, "emptied": 4, "kept": 0}
    assert now(store, rollups.RECORDS, df) == []


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    store, first = rollups.RollupStore(spark, str(tmp_path)), table(spark, rows())
    store.refresh(rollups.SHARES, first)
    more = table(spark, rows([(DAYS[4], 1, "new", 78, 1, 1)]))

    def fails(_):
        raise OSError("lost")

    broken = rollups.Rollup(rollups.SHARES.name, fails)
    with pytest.raises(OSError):
        store.refresh(broken, more)
    # Hashes without their mark of success do not count.
    (folder,) = os.listdir(tmp_path / "_daily_shares-days")
    (tmp_path / "_daily_shares-days" / "999999999999-broken").mkdir()
    assert store.refresh(rollups.SHARES, more) == {"written": 1, "emptied": 0, "kept": 4}
    assert now(store, rollups.SHARES, more) == made(rollups.SHARES, more)
    assert folder not in os.listdir(tmp_path / "_daily_shares-days")
    assert store.refresh(rollups.SHARES, more)["written"] == 0


def test_many_days_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "LISTED", 2)
    store, first = rollups.RollupStore(spark, str(tmp_path)), table(spark, rows())
    assert store.refresh(rollups.SHARES, first)["written"] == 5 and now(store, rollups.SHARES, first) == made(rollups.SHARES, first)


def test_content_tells_values_and_nulls_apart(spark):
    def sums(data):
        return sorted((r["n"], r["low"], r["high"]) for r in rollups.content(table(spark, data)).collect())

    one = [(DAYS[0], 1, "a", 1, None, 2), (DAYS[0], 1, None, 2, 1, 1)]
    assert sums(one) == sums(one[::-1])
    for other in ([one[0]], one + [one[0]], [(DAYS[0], 1, "a", 1, 2, None), one[1]], [(DAYS[0], 1, "b", 1, None, 2), one[1]]):
        assert sums(one) != sums(other)


def test_cards_of_labels(spark, tmp_path):
    decks = spark.createDataFrame([(1, 5, 3, 0), (2, 5, None, None), (3, 6, 1, 1)], "id long, event_id long, wins int, losses int")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "deck_id long, label string")
    events = spark.createDataFrame([(5, 1, DAYS[0]), (6, 1, DAYS[1])], "id long, format_id int, date date")
    lines = spark.createDataFrame([(1, 7, "main", 4), (1, 8, "side", 1), (2, 7, "main", 2)], "deck_id long, card_id long, board string, count int")
    df = rollups.labelled_rows(decks, labels, events, lines)
    store = rollups.RollupStore(spark, str(tmp_path))
    store.refresh(rollups.CARDS, df)
    assert now(store, rollups.CARDS, df) == [(1, "x", 7, "main", 2, 6, DAYS[0]), (1, "x", 8, "side", 1, 1, DAYS[0])]
    assert store.read(rollups.SHARES, rollups.labelled_rows(decks, labels, events)).where(F.col("label").isNull()).count() == 0


def test_decks_with_days_of_their_own(spark):
    """Each deck is one row, whatever other days its event's decks have."""
    decks = spark.createDataFrame([(k, 5, k, 0, DAYS[k % 3]) for k in range(9)] + [(9, 5, 1, 1, None)], "id long, event_id long, wins int, losses int, date date")
    labels = decks.select(F.col("id").alias("deck_id"), F.lit("x").alias("label"))
    events = spark.createDataFrame([(5, 1)], "id long, format_id int")
    found = rollups.labelled_rows(decks, labels, events)
    assert sorted((r["deck_id"], r["date"]) for r in found.collect()) == [(k, DAYS[k % 3] if k < 9 else None) for k in range(10)]


def test_a_rollup_goes_straight_to_its_files(spark, tmp_path, monkeypatch):
    """Only contents of days, never the rows of the rollup, are put down before."""
    kept, plain = [], rollups.cut
    monkeypatch.setattr(rollups, "cut", lambda df: kept.append(df.columns) or plain(df))
    store, first = rollups.RollupStore(spark, str(tmp_path)), table(spark, rows())
    store.refresh(rollups.SHARES, first)
    assert kept == [["date", "n", "low", "high"]] and now(store, rollups.SHARES, first) == made(rollups.SHARES, first)


def test_sums_at_the_limit_are_those_of_the_sql(spark):
    """Deviations of just three, less the slack, are the limit: the last digit decides, and is that of sums from day to day."""
    import duckdb

    from deckloom.operators import alerts
    from deckloom.plans.forecasts import _cusum_sql

    series = [[43, 44, 40, 43, 47, 12, 30], [45, 29, 47, 39, 19, 36, 10, 49], [23, 39, 35, 35, 15], [5, 5, 5, 5, 9]]
    data = [(k, date(2024, 1, 1 + i), float(x)) for k, xs in enumerate(series) for i, x in enumerate(xs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE a (label INTEGER, date DATE, copies DOUBLE)")
    con.executemany("INSERT INTO a VALUES (?, ?, ?)", data)
    sql = "WITH x AS (SELECT 1)" + _cusum_sql("a", "label", "copies", 0.5, 2.5, 3) + " SELECT label, date, copies, up, down, alarm FROM al"
    found = alerts.cusum(spark.createDataFrame(data, "label int, date date, copies double"), ["label"], "copies", 0.5, 2.5, 3)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(sql).fetchall(), key=str)
