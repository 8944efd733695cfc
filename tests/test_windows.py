"""The layout for windows: same rows as the canonical tables, months that are not asked for stay unread, and no shuffle."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from deckloom.operators.importer import load_window, window_decks
from deckloom.sources.windows import WindowLayout


@pytest.fixture(scope="module")
def tables(spark):
    events = [(k, 1 if k % 3 else 2, date(2024, 1, 1) + timedelta(9 * k) if k != 5 else None) for k in range(20)] + [(20, None, date(2024, 1, 1))]
    decks = [(10 * k + i, k) for k in range(21) for i in range(4)]
    lines = [(d, c, 1 + c % 3, "main" if c % 2 else "side") for d, _ in decks for c in range(d % 5)]
    return {
        "games": spark.createDataFrame([(1, "g")], "id int, name string"),
        "formats": spark.createDataFrame([(1, 1, "modern"), (2, 1, "legacy")], "id int, game_id int, name string"),
        "events": spark.createDataFrame(events, "id long, format_id int, date date"),
        "decks": spark.createDataFrame(decks, "id long, event_id long"),
        "deck_cards": spark.createDataFrame(lines, "deck_id long, card_id long, count int, board string"),
    }


@pytest.fixture(scope="module")
def layout(spark, tables, tmp_path_factory):
    layout = WindowLayout(spark, f"file://{tmp_path_factory.mktemp('layout')}", "test_windows", 4)
    layout.write(tables["events"], tables["decks"], tables["deck_cards"])
    yield layout
    layout.drop()


def rows(df):
    return sorted(map(tuple, df.collect()))


WINDOWS = [(date(2024, 1, 1), date(2024, 12, 31)), (date(2024, 2, 10), date(2024, 3, 2)), (date(2023, 1, 1), date(2023, 2, 1)), (date(2024, 1, 10), date(2024, 1, 10))]


@pytest.mark.parametrize("start, end", WINDOWS)
@pytest.mark.parametrize("name, number", [("modern", 1), ("legacy", 2)])
def test_same_rows(layout, tables, start, end, name, number):
    assert rows(layout.window_decks(start, end, [number])) == rows(window_decks(tables, start, end, name))
    assert rows(layout.load_window(start, end, [number])) == rows(load_window(tables, start, end, name).select("deck_id", "date", "card_id", "count", "board"))


def test_nothing_is_shuffled_and_other_months_stay_unread(spark, layout):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout.load_window(date(2024, 2, 10), date(2024, 3, 2), [1])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("month") >= 2 and "SelectedBucketsCount: 4 out of 4" in plan
        read = {x.split("month=")[1][:7] for x in found.inputFiles()}
        assert read == {"2024-02", "2024-03"}
        # Sums by deck stay within buckets, too.
        assert "Exchange" not in found.groupBy("deck_id").sum("count")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_another_session_declares_the_same_files(layout):
    again = WindowLayout(layout.spark, layout.root, "again_windows", 4)
    again.declare()
    start, end = WINDOWS[0]
    assert rows(again.load_window(start, end, [1, 2])) == rows(layout.load_window(start, end, [1, 2]))
    assert "again" not in layout.spark.table("test_windows_decks").columns
    again.drop()
    assert rows(layout.window_decks(start, end, [1]))


def test_one_name_in_several_games(spark, tables):
    formats = spark.createDataFrame([(1, 1, "modern"), (2, 2, "modern")], "id int, game_id int, name string")
    games = spark.createDataFrame([(1, "g"), (2, "h")], "id int, name string")
    both = tables | {"formats": formats, "games": games}
    start, end = WINDOWS[0]
    with pytest.raises(ValueError, match="several games"):
        window_decks(both, start, end, "modern")
    assert rows(window_decks(both, start, end, "modern", "h")) == rows(window_decks(tables, start, end, "legacy"))


def test_a_bucket_of_a_month_is_a_file_and_no_task_has_a_whole_bucket(spark, tables, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout = WindowLayout(spark, f"file://{tmp_path}", "spread_windows", 2)
    try:
        layout.write(tables["events"], tables["decks"], tables["deck_cards"])
        for part in ("decks", "deck_cards"):
            files = [x.rsplit("/", 3)[1:] for x in spark.table(f"spread_windows_{part}").inputFiles()]
            placed = [(folder, month, name.rsplit("_", 1)[1][:5]) for folder, month, name in files]
            assert len(set(placed)) == len(placed)
            tasks = {(bucket, name.split("-")[1]) for (*_, bucket), (*_, name) in zip(placed, files)}
            assert len({task for _, task in tasks}) > 2 and len(tasks) > 2
        start, end = WINDOWS[0]
        assert rows(layout.load_window(start, end, [1])) == rows(load_window(tables, start, end, "modern").select("deck_id", "date", "card_id", "count", "board"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        layout.drop()
