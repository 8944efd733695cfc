"""From raw documents to canonical tables, on files made here."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from deckloom import cli
from deckloom.operators import importer, quality, trends
from deckloom.schemas import TABLES
from deckloom.sources import cards, events, tables
from deckloom.sources.definitions import Format, load_formats

FORMATS = [Format("cards", "modern", True, ("modern",)), Format("cards", "legacy", False, ("legacy",))]


def lines(*pairs):
    return [{"CardName": n, "Count": c} for n, c in pairs]


def deck(player, result="", main=(), side=(), **more):
    return {"Date": None, "Player": player, "Result": result, "AnchorUri": "", "Mainboard": lines(*main), "Sideboard": lines(*side), **more}


CARDS = [
    {"oracle_id": "a", "name": "Bolt", "layout": "normal", "set_type": "core", "type_line": "Instant"},
    {"oracle_id": "b", "name": "Fire // Ice", "layout": "split", "set_type": "core", "type_line": "Instant", "card_faces": [{"name": "Fire"}, {"name": "Ice"}]},
    {"oracle_id": "c", "name": "Fire", "layout": "normal", "set_type": "core", "type_line": "Sorcery"},
    {"oracle_id": "d", "name": "Bolt", "layout": "normal", "set_type": "funny", "type_line": "Instant"},
    {"oracle_id": "e", "name": "Goblin", "layout": "token", "set_type": "token", "type_line": "Creature"},
    {"oracle_id": "f", "name": "Plains", "layout": "normal", "set_type": "core", "type_line": "Basic Land"},
]


def write(root, path, doc):
    file = root / "Tournaments" / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(doc))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    first = {
        "Tournament": {"Date": "2023-03-05T23:00:00-08:00", "Name": "Open", "Uri": "u"},
        "Decks": [
            deck("ann", "1st Place", [("Bolt", 4), ("bolt", 1), ("Bolt", 2)], [("Fire && Ice", 2)]),
            deck("bob", "5-0", [("Fire", 1), ("Nope", 3), ("Plains", 0)]),
            deck("cat", "2-1-1", [("ICE", 1)]),
            deck(None, "3-2", []),
        ],
        "Rounds": [{"RoundName": "R1", "Matches": [{"Player1": "ann", "Player2": "bob", "Result": "2-0"}, {"Player1": "x", "Player2": "y", "Result": "2-1"}]}],
        "Standings": [
            {"Player": "ann", "Rank": 9, "Wins": 9, "Losses": 9, "Draws": 9},
            {"Player": "ann", "Rank": 1, "Wins": 4, "Losses": 0, "Draws": 0},
            {"Player": "bob", "Rank": None, "Losses": 3},
            {"Player": "dan", "Rank": 3, "Wins": 1, "Losses": 2, "Draws": 0},
        ],
    }
    plain = {"Tournament": {"Date": "junk", "Name": None, "Uri": ""}, "Decks": [deck("eve", "4-1", [("Bolt", 1)])], "Rounds": None, "Standings": None}
    write(root, "a/2023/03/06/modern-open.json", first)
    write(root, "a-b/2023/03/01/modern-x.json", plain)
    write(root, "a/2023/03/07/modern-open.json", plain)
    write(root, "mtgo.com/2023/03/08/modern-league-2023-03-08.json", {"Tournament": {}, "Decks": None})
    write(root, "a/2023/03/06/open.json", plain)
    write(root, "a/2023/03/06/legacy-cup.json", plain)
    catalogue = root / "cards.json"
    catalogue.write_text("\n\n".join(json.dumps(c) for c in CARDS))
    (root / "array.json").write_text(json.dumps(CARDS))
    return root


@pytest.fixture(scope="module")
def imported(spark, corpus, tmp_path_factory):
    store = tables.Store(spark, str(tmp_path_factory.mktemp("store")))
    with pytest.raises(RuntimeError, match="no cards"):
        importer.run_import(store, str(corpus), FORMATS, "cards")
    store.load_cards(cards.card_table(cards.read_cards(spark, str(corpus / "cards.json"))))
    return store, importer.run_import(store, str(corpus), FORMATS, "cards")


def test_framings_read_alike(spark, corpus):
    a, b = (cards.read_cards(spark, str(corpus / f)).orderBy("oracle_id").collect() for f in ("cards.json", "array.json"))
    assert a == b and len(a) == 6


def test_card_table(spark, corpus):
    raw = cards.read_cards(spark, str(corpus / "array.json"))
    rows = {r["canonical_ref"]: r for r in cards.card_table(raw).collect()}
    assert sorted(rows) == ["a", "b", "c", "d", "f"]
    assert rows["d"]["id"] == 5 and rows["a"]["id"] == 1  # the second tier comes last
    assert rows["b"]["attrs"]["face_names"] == ["Fire", "Ice"] and rows["a"]["attrs"]["face_names"] is None
    assert [tuple(r) for r in cards.left_out(raw).collect()] == [("token", 1)]
    with pytest.raises(ValueError, match="twice"):
        cards.card_table(raw.unionByName(raw)).count()


def test_cards_load_once(spark, corpus, imported):
    with pytest.raises(RuntimeError, match="not empty"):
        imported[0].load_cards(cards.card_table(cards.read_cards(spark, str(corpus / "cards.json"))))


def test_counts(imported):
    counts = imported[1].counts
    want = {
        "files_seen": 6, "format_unknown": 1, "other_format": 1, "duplicate": 1, "events": 3, "decks": 5,
        "standings_only_players": 1, "decks_without_standing": 2, "zero_count_lines": 1, "unresolved_names": 1, "decks_with_unresolved": 1,
    }
    assert {k: counts[k] for k in want} == want


def test_events(imported):
    rows = {r["source_event_id"]: r for r in imported[0].read("events").collect()}
    first, league, x = rows["modern-open"], rows["modern-league-2023-03-08"], rows["modern-x"]
    assert [r["source_event_id"] for r in sorted(rows.values(), key=lambda r: r["id"])] == ["modern-open", "modern-x", "modern-league-2023-03-08"]
    assert first["date"] == date(2023, 3, 5) and x["date"] == date(2023, 3, 1)
    assert (first["player_count"], x["player_count"], league["player_count"]) == (3, 1, 0)
    assert (first["event_type"], league["event_type"]) == ("tournament", "league")
    assert first["raw_ref"] == "Tournaments/a/2023/03/06/modern-open.json"


def test_decks(imported):
    rows = imported[0].read("decks").orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5]
    got = [(r["player"], r["finish_rank"], r["wins"], r["losses"], r["draws"]) for r in rows]
    assert got == [("ann", 1, 4, 0, 0), ("bob", None, 5, 3, None), ("cat", None, 2, 1, 1), (None, None, 3, 2, None), ("eve", None, 4, 1, None)]


def test_deck_cards(imported):
    rows = {tuple(r) for r in imported[0].read("deck_cards").collect()}
    assert rows == {(1, 1, 7, "main"), (1, 2, 2, "side"), (2, 3, 1, "main"), (3, 2, 1, "main"), (5, 1, 1, "main")}


def test_unresolved_adds_up(spark, corpus, imported):
    store = imported[0]
    assert [tuple(r)[3:] for r in store.read("ingest_unresolved_cards").collect()] == [("Nope", 1, 1)]
    before = {n: sorted(map(str, store.read(n).collect())) for n in ("events", "decks", "deck_cards", "formats", "games")}
    importer.run_import(store, str(corpus), FORMATS, "cards")
    assert [tuple(r)[3:] for r in store.read("ingest_unresolved_cards").collect()] == [("Nope", 2, 2)]
    assert before == {n: sorted(map(str, store.read(n).collect())) for n in before}


def test_ids_do_not_collide(spark, corpus, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.load_cards(cards.card_table(cards.read_cards(spark, str(corpus / "cards.json"))))
    importer.run_import(store, str(corpus), FORMATS, "cards")
    ids = {r["name"]: r["id"] for r in store.read("formats").collect()}
    # A format put first keeps the others' ids; a second game has one of its own.
    more = [Format("cards", "vintage", False, ("vintage",)), *FORMATS, Format("dice", "modern", True, ("modern",))]
    importer.run_import(store, str(corpus), more, "cards")
    store.swap("games", importer.game_rows(store, "dice"))
    game = {r["name"]: r["id"] for r in store.read("games").collect()}
    store.swap("formats", importer.format_rows(store, [more[-1]], game["dice"]))
    rows = [(r["game_id"], r["name"], r["id"]) for r in store.read("formats").collect()]
    assert game == {"cards": 1, "dice": 2} and len({i for *_, i in rows}) == len(rows) == 4
    assert {n: i for g, n, i in rows if g == 1 and n in ids} == ids and (2, "modern") in {(g, n) for g, n, _ in rows}


def test_failed_checks_leave_the_old_tables(spark, corpus, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.load_cards(cards.card_table(cards.read_cards(spark, str(corpus / "cards.json"))))
    importer.run_import(store, str(corpus), FORMATS, "cards")
    before = sorted(map(str, store.read("decks").collect()))
    with pytest.raises(ValueError, match="future"):
        importer.run_import(store, str(corpus), FORMATS, "cards", today=date(2020, 1, 1))
    assert sorted(map(str, store.read("decks").collect())) == before
    assert {p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")} == {"cards", "games", "formats", "events", "decks", "deck_cards", "ingest_unresolved_cards"}
    # A swap that was broken off in the middle.
    (tmp_path / "store/decks").rename(tmp_path / "store/_decks-before")
    assert sorted(map(str, store.read("decks").collect())) == before
    store.swap("decks", store.read("decks"))
    assert sorted(map(str, store.read("decks").collect())) == before


def test_numbers_over_ranges(spark):
    from deckloom.operators.numbering import numbered

    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n")).repartition(5, "n")
    found = numbered(rows, ["k"], "place", {"before": "n"}).orderBy("k").collect()
    assert [r["place"] for r in found] == list(range(1, 1001))
    assert [r["before"] for r in found] == [sum(j % 7 for j in range(k)) for k in range(1000)]
    assert numbered(rows.where("false"), ["k"]).count() == 0


def test_gates(imported):
    store = imported[0]
    found = {n: store.read(n) for n in TABLES}
    quality.gates(found)
    with pytest.raises(ValueError, match="no decks.*deck_cards with count < 1"):
        quality.gates(found | {"decks": found["decks"].where("false"), "deck_cards": found["deck_cards"].withColumn("count", found["deck_cards"]["count"] - 7)})


def test_report(imported):
    text = quality.report({n: imported[0].read(n) for n in TABLES}, "2024-01-01")
    assert "All checks pass: **True**" in text and "| events | 3 |" in text and "| Nope |" in text


def test_window(imported):
    rows = importer.load_window(imported[0], date(2023, 3, 1), date(2023, 3, 5), "modern", "cards")
    assert {r["deck_id"] for r in rows.collect()} == {1, 2, 3, 5}
    assert importer.load_window(imported[0], date(2023, 3, 1), date(2023, 3, 5), "legacy").count() == 0


def test_matches(spark, corpus, imported):
    docs, _ = events.select_events(events.read_events(spark, str(corpus)), {"modern": ["modern"], "legacy": ["legacy"]}, {"modern"})
    ids = imported[0].read("events").select("id", "raw_ref")
    rows = trends.matches(docs.join(ids, "raw_ref"), imported[0].read("decks")).collect()
    assert [(r["round"], r["deck_id_a"], r["deck_id_b"], r["result"]) for r in rows] == [("R1", 1, 2, "2-0")]


def test_empty_corpus(spark, tmp_path, corpus):
    (tmp_path / "c/Tournaments/a/2020/01/01").mkdir(parents=True)
    (tmp_path / "c/Tournaments/a/2020/01/01/other.json").write_text("{}")
    store = tables.Store(spark, str(tmp_path / "s"))
    store.load_cards(cards.card_table(cards.read_cards(spark, str(corpus / "cards.json"))))
    with pytest.raises(ValueError, match="no events; no decks"):
        importer.run_import(store, str(tmp_path / "c"), FORMATS, "cards")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, s string, n int")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], ["s"]).collect()} == {(1, "a", 1), (2, None, 2), (3, "c", 6)}
    assert {tuple(r) for r in tables.upsert_additive(old, new, ["k"], ["n"]).collect()} == {(1, 1), (2, 7), (3, 6)}
    assert {r["k"] for r in tables.insert_absent(old, new, ["k"]).collect()} == {1, 2, 3}


def test_formats_file(tmp_path):
    f = {"name": "modern", "import": True, "slug_tokens": ["modern"], "board_zones": ["main", "side"], "expected_mainboard_min": 60, "expected_sideboard_max": 15, "vector_exclude_type_line_prefixes": ["Basic Land"]}
    (tmp_path / "formats.json").write_text(json.dumps({"games": [{"name": "g", "formats": [f]}]}))
    assert load_formats(tmp_path / "formats.json") == [Format("g", "modern", True, ("modern",), vector_exclude_type_line_prefixes=("Basic Land",))]


def test_command_line(spark, corpus, tmp_path):
    f = {"name": "modern", "import": True, "slug_tokens": ["modern"], "board_zones": ["main", "side"], "expected_mainboard_min": 60, "expected_sideboard_max": 15, "vector_exclude_type_line_prefixes": []}
    (tmp_path / "formats.json").write_text(json.dumps({"games": [{"name": "g", "formats": [f]}]}))
    rules = tmp_path / "rules/modern/Archetypes"
    rules.mkdir(parents=True)
    (rules / "Burn.json").write_text('{"Name": "Burn", "Conditions": [{"Type": "InMainboard", "Cards": ["Bolt",]}]}')
    store = ["--store", str(tmp_path / "s")]
    assert cli.main([*store, "cards", "--file", str(corpus / "cards.json")]) == 0
    assert cli.main([*store, "events", "--root", str(corpus), "--formats", str(tmp_path / "formats.json"), "--game", "g"]) == 0
    assert cli.main([*store, "report", "--out", str(tmp_path / "r.md"), "--date", "2024-01-01"]) == 0
    assert "Integrity" in (tmp_path / "r.md").read_text()
    assert cli.main([*store, "classify", "--definitions", str(tmp_path / "rules"), "--format", "modern", "--out", str(tmp_path / "l")]) == 0
    labels = {r["deck_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "l")).collect()}
    assert {k for k, v in labels.items() if v == "Burn"} == {1, 5}


def test_broken_documents_are_counted_or_refused(spark, tmp_path):
    good = {"Tournament": {"Date": "2023-03-05", "Name": "x", "Uri": ""}, "Decks": [deck("eve", "4-1", [("Bolt", 1)])], "Rounds": None, "Standings": None}
    write(tmp_path, "a/2023/03/06/modern-good.json", good)
    write(tmp_path, "a/2023/03/06/modern-other-type.json", good | {"Decks": "none"})
    (tmp_path / "Tournaments/a/2023/03/06/modern-cut.json").write_text(json.dumps(good)[:60])
    (tmp_path / "Tournaments/a/2023/03/06/modern-empty.json").write_text("")
    found = {r["slug"]: r["broken"] for r in events.read_events(spark, str(tmp_path)).collect()}
    assert {"modern-good": False, "modern-other-type": True, "modern-cut": True}.items() <= found.items() and found.get("modern-empty") in (None, True)
    catalogue = tmp_path / "cards.json"
    catalogue.write_text("\n".join(json.dumps(c) for c in CARDS))
    store = tables.Store(spark, str(tmp_path / "store"))
    store.load_cards(cards.card_table(cards.read_cards(spark, str(catalogue))))
    with pytest.raises(ValueError, match="modern-cut"):
        importer.run_import(store, str(tmp_path), FORMATS, "cards")
    assert not store.exists("events")
    counts = importer.run_import(store, str(tmp_path), FORMATS, "cards", skip_broken=True).counts
    assert (counts["broken"], counts["events"], counts["decks"]) == (len(found) - 1, 1, 1)
