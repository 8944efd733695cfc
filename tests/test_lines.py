"""Card lines that sum up to a deck's cards: joined before they are summed, so that no task holds nearly all of them in a map."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import functions as F

from deckloom.operators import importer, quality, trends
from deckloom.plans import catalog, star

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summed_whole(df) -> bool:
    """Whether sums of all lines are shuffled by deck, card and board."""
    return re.search(r"hashpartitioning\(deck_id#\w+, card_id#\w+, board#", plan(df)) is not None


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_window_sums_the_lines_of_its_own_decks_only(spark):
    assert summed_whole(star.deck_cards(spark, SF))
    asked = []

    def cards(decks):
        asked.append(decks)
        return star.deck_cards(spark, SF, decks)

    tables = star.tables(spark, SF)
    args = "1995-01-01", "1997-12-31", "NATION_3"
    found = importer.load_window(tables | {"deck_cards": cards}, *args)
    assert rows(found) == rows(importer.load_window(tables, *args)) and found.count() > 0
    assert rows(asked[0]) == rows(importer.window_decks(tables, *args))
    for df in (found, catalog.QUERIES["q_window_load"](spark, SF)):
        assert not summed_whole(df) and re.search(r"ShuffledHashJoin \[deck_id#\w+\], \[deck_id#\w+\], LeftSemi", plan(df))


def test_orphans_of_lines(spark):
    lines = [(1, 1, "main"), (1, 1, "main"), (1, 1, "side"), (2, 1, "main"), (2, 3, "main"), (2, 3, "main"), (None, 1, "main"), (None, 1, "main"), (3, None, "side")]
    frame = spark.createDataFrame
    ids = lambda *k: frame([(x,) for x in k], "id long")
    cards = frame(lines, "deck_id long, card_id long, board string")
    tables = {
        "games": ids(1), "formats": ids(1), "cards": ids(1, 2), "decks": frame([(1, 1), (3, 9)], "id long, event_id long"),
        "events": frame([(1, 1, 1)], "id long, format_id long, game_id long"), "deck_cards": cards,
    }
    found = dict(rows(quality.orphans(tables, {"deck_cards": star.LINE})))
    assert found == dict(rows(quality.orphans(tables | {"deck_cards": cards.distinct()})))
    # Decks 2 and null; card 3 and null.
    assert found == {"decks -> events": 1, "deck_cards -> decks": 3, "deck_cards -> cards": 2, "events -> formats": 0, "events -> games": 0}


def test_orphans_are_found_before_lines_are_summed(spark):
    assert not summed_whole(catalog.QUERIES["q_orphans"](spark, SF))


def test_drift_of_lines(spark):
    day = [date(2024, 1, k) for k in range(1, 4)]
    lines = [
        ("a", 1, day[0], 1, "main", 2), ("a", 1, day[0], 1, "main", 3), ("a", 1, day[0], 1, "side", 4), ("a", 1, day[0], 2, "main", 3),
        ("a", 1, day[2], 1, "main", 1), ("a", 1, None, 4, "main", None), ("a", 2, day[1], 1, "main", 7), ("b", 1, day[1], 9, "side", 1), (None, 1, day[1], 9, "side", 5),
    ]
    frame = spark.createDataFrame(lines, "label string, card_id long, date date, deck_id long, board string, count long")
    found = trends.card_drift(frame, star.LINE)
    summed = frame.groupBy("label", "date", *star.LINE).agg(F.sum("count").alias("count"))
    assert rows(found) == rows(trends.card_drift(summed))
    assert [(r["copies"], r["change"]) for r in found.where("label = 'a' and card_id = 1 and date is not null").orderBy("date").collect()][0][0] == 4.0
    assert found.count() == 6


def test_drift_shuffles_and_sorts_lines_once(spark):
    for name in ("q_card_drift", "q_card_spikes"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert not summed_whole(catalog.QUERIES[name](spark, SF))
        assert len(re.findall(r"hashpartitioning\(label#\w+, card_id#", text)) == 1
    text = plan(catalog.QUERIES["q_card_drift"](spark, SF))
    assert len(re.findall(r"Sort \[label#", text)) == 1 and "HashAggregate" not in text
