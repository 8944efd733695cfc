"""Labels in the canonical tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deckloom import cli
from deckloom.operators import labels
from deckloom.schemas import TABLES
from deckloom.sources.tables import Store

CLASSIFIED = "deck_id long, archetype string, variant string, method string, similarity double"


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    decks = [(k, 1 + k // 6, None, None, None, None, None, 77 if k == 9 else None, "old" if k == 9 else None) for k in range(1, 11)]
    store.write("decks", spark.createDataFrame(decks, TABLES["decks"]))
    return store


def run(store, rows, version, format_id=1):
    return labels.store_labels(store, store.spark.createDataFrame(rows, CLASSIFIED), format_id, version, F.lit("2024-01-01"))


def names(store):
    return {r["id"]: (r["format_id"], r["name"], r["parent_id"]) for r in store.read("archetypes").collect()}


def test_labels_of_two_versions(store):
    first = [(1, "Burn", None, "rules", 1.0), (2, "Aggro", "Red", "rules", 1.0), (3, None, None, None, None), (4, "Burn", None, "fallback", 0.4)]
    assert run(store, first, "1") == {"decks": 4, "labelled": 3, "archetypes": 3}
    assert names(store) == {1: (1, "Aggro", None), 2: (1, "Burn", None), 3: (1, "Red", 1)}
    before = sorted(map(str, store.read("archetype_labels").collect()))
    assert run(store, first, "1") == {"decks": 4, "labelled": 3, "archetypes": 3}
    assert sorted(map(str, store.read("archetype_labels").collect())) == before
    decks = {r["id"]: (r["archetype_id"], r["classifier_version"]) for r in store.read("decks").collect()}
    assert (decks[1], decks[2], decks[3], decks[5], decks[9]) == ((2, "1"), (3, "1"), (None, "1"), (None, None), (77, "old"))
    # A later version: known names keep their ids, the old version's labels stay.
    assert run(store, [(1, "Control", None, "rules", 1.0), (2, "Aggro", "Blue", "rules", 1.0), (9, None, None, None, None)], "2")["archetypes"] == 5
    assert names(store) == {1: (1, "Aggro", None), 2: (1, "Burn", None), 3: (1, "Red", 1), 4: (1, "Control", None), 5: (1, "Blue", 1)}
    decks = {r["id"]: (r["archetype_id"], r["classifier_version"]) for r in store.read("decks").collect()}
    assert (decks[1], decks[2], decks[4], decks[9]) == ((4, "2"), (5, "2"), (2, "1"), (None, "2"))
    assert store.read("archetype_labels").where("classifier_version = '1'").count() == 3
    current = labels.current_labels(store.read("archetype_labels"), store.read("archetypes"), "2").collect()
    assert {(r["deck_id"], r["label"], r["parent"]) for r in current} == {(1, "Control", None), (2, "Blue", "Aggro")}


def test_a_deck_that_loses_its_label(store):
    run(store, [(1, "Burn", None, "rules", 1.0)], "1")
    run(store, [(1, None, None, None, None)], "1")
    assert store.read("archetype_labels").count() == 0 and store.read("decks").where("id = 1 and archetype_id is null and classifier_version = '1'").count() == 1


def test_formats_have_archetypes_of_their_own(store):
    run(store, [(1, "Burn", None, "rules", 1.0)], "1")
    run(store, [(7, "Burn", "Burn", "rules", 1.0)], "1", format_id=2)
    assert names(store) == {1: (1, "Burn", None), 2: (2, "Burn", None)}


def test_a_name_of_several_formats(store):
    spark = store.spark
    config = (["modern"], ["main"], 60, 15, [])
    store.write("games", spark.createDataFrame([(1, "a"), (2, "b")], TABLES["games"]))
    store.write("formats", spark.createDataFrame([(1, 1, "modern", config), (2, 2, "modern", config), (3, 2, "other", config)], TABLES["formats"]))
    assert cli.format_of(store, "modern", "b") == 2 and cli.format_of(store, "other", None) == 3
    for name, game in (("modern", None), ("none", None)):
        with pytest.raises(ValueError):
            cli.format_of(store, name, game)
