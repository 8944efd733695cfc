"""The evaluation as a whole, on kinds of decks made here."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta

import pytest

from deckloom import cli
from deckloom.operators import evaluate, holdout
from deckloom.schemas import TABLES
from deckloom.sources import tables
from deckloom.sources.definitions import load_definitions

KINDS = {"Red": range(1, 13), "Blue": range(21, 33), "New": range(41, 53)}
KEY_CARD = 41


def made(spark, root):
    """A store with decks of three kinds and some strays. The third kind begins on the tenth of March; a few decks have the wrong kind's key card."""
    rng = random.Random(1)
    events, decks, lines = [], [], []
    day, deck = date(2024, 3, 1), 0
    for e in range(30):
        events.append((e + 1, 1, "src", f"e{e}", 1, None, day + timedelta(days=e), "tournament", 0, f"r{e}"))
        kinds = ["Red"] * 3 + ["Blue"] * 2 + (["New"] * 2 if e >= 9 else []) + [None]
        for kind in kinds:
            deck += 1
            decks.append((deck, e + 1, f"p{deck}", None, None, None, None, None, None))
            cards = rng.sample(range(100, 400), 12) if kind is None else [*rng.sample(list(KINDS[kind]), 10), *rng.sample(range(60, 70), 2)]
            if kind and min(KINDS[kind]) not in cards:
                cards[0] = min(KINDS[kind])
            lines += [(deck, c, rng.randint(1, 4), "main") for c in cards] + [(deck, 77, 1, "side")]
        deck += 1
        decks.append((deck, e + 1, "empty", None, None, None, None, None, None))
    store = tables.Store(spark, str(root))
    config = (["modern"], ["main", "side"], 60, 15, ["Basic"])
    frame = lambda name, rows: store.write(name, spark.createDataFrame(rows, TABLES[name]))
    frame("games", [(1, "cards")])
    frame("formats", [(1, 1, "modern", config)])
    frame("cards", [(c, 1, f"ref{c}", f"Card {c}", ("normal", "core", "Basic Land" if c == 69 else "Thing", 0, None)) for c in range(1, 400)])
    frame("events", events)
    frame("decks", decks)
    frame("deck_cards", lines)
    return store, deck - 30


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return made(spark, tmp_path_factory.mktemp("evaluated"))


@pytest.fixture(scope="module")
def definitions(tmp_path_factory):
    root = tmp_path_factory.mktemp("rules")
    (root / "modern/Archetypes").mkdir(parents=True)
    (root / "modern/Fallbacks").mkdir()
    for name, cards in KINDS.items():
        rule = {"Name": name, "Conditions": [{"Type": "InMainboard", "Cards": [f"Card {min(cards)}"]}]}
        (root / f"modern/Archetypes/{name}.json").write_text(json.dumps(rule))
    (root / "modern/Fallbacks/Pile.json").write_text(json.dumps({"Name": "Pile", "CommonCards": [f"Card {c}" for c in range(100, 250)]}))
    return root


def run(store, definitions, **more):
    read = {n: store.read(n) for n in TABLES}
    known = {f"Card {c}": c for c in range(1, 400)}.get
    releases = (holdout.Release("set", "New", f"Card {KEY_CARD}", date(2024, 3, 1)),)
    load = lambda hidden: load_definitions(definitions, "modern", known, without=hidden)
    return holdout.evaluation(read, load, "modern", "cards", date(2024, 3, 1), date(2024, 3, 30), **{"releases": releases, "established": 20} | more)


def test_evaluation(spark, store, definitions):
    store, n = store
    found = run(store, definitions)
    h = found.holdout
    assert (h.decks, h.labelled, h.conflicts) == (n, 30 * 5 + 21 * 2, 0) and 0 < h.fallback <= 30
    assert [(name, k) for name, k, *_ in h.per_label] == [("Blue", 60), ("New", 42), ("Red", 90)]
    assert h.agreement > 0.95 and h.worst_f1 > 0.95 and h.rand_index > 0.9 and h.version.startswith("rules-")
    ((_, e),) = found.releases
    # Two decks a day from the tenth on: the fifth is there on the twelfth.
    assert (e.target_decks, e.first, e.deadline) == (42, date(2024, 3, 12), date(2024, 3, 19))
    assert e.passed and e.detected_on == date(2024, 3, 12) and e.size >= 5 and e.purity > 0.5
    assert found.verdict == {"agreement": True, "f1": True, "emergence": True}


def test_agreement_by_counting(spark, store, definitions):
    """Majority labels, agreement and F1 from the collected clusters, counted here."""
    store, _ = store
    read = {n: store.read(n) for n in TABLES}
    cards, decks = holdout.window(read, date(2024, 3, 1), date(2024, 3, 30), "modern", "cards")
    slices = decks.selectExpr("'holdout' as slice", "deck_id")
    cluster = {r["deck_id"]: r["cluster"] for r in holdout.clustered_slices(cards, slices, holdout.excluded_cards(read, "modern")).collect()}
    main = {}
    for r in cards.where("board = 'main'").collect():
        main.setdefault(r["deck_id"], set()).add(r["card_id"])
    truth = {d: name for d, zone in main.items() for name, kind in KINDS.items() if min(kind) in zone}
    label = {}
    for c in set(cluster.values()) - {-1}:
        votes = [truth[d] for d in cluster if cluster[d] == c and d in truth]
        label[c] = min(set(votes), key=lambda x: (-votes.count(x), x)) if votes else None
    said = {d: label.get(cluster[d]) for d in cluster}
    h = run(store, definitions, releases=()).holdout
    assert h.agreement == sum(said[d] == truth[d] for d in truth) / len(truth)
    assert (h.clusters, h.noise) == (len(label), sum(c == -1 for c in cluster.values()))
    for name, n, precision, recall, f1 in h.per_label:
        hits = sum(said[d] == name == truth[d] for d in truth)
        p, r = hits / sum(said[d] == name for d in truth), hits / n
        assert (precision, recall, f1) == (p, r, 2 * p * r / (p + r))


def test_hiding_takes_one_rule(spark, store, definitions):
    with pytest.raises(ValueError, match="takes 0 rules"):
        run(store[0], definitions, releases=(holdout.Release("x", "Nothing", "Card 1", date(2024, 3, 1)),))
    with pytest.raises(ValueError, match="no card named"):
        run(store[0], definitions, releases=(holdout.Release("x", "New", "Card 999", date(2024, 3, 1)),))


def test_command(spark, store, definitions, tmp_path, monkeypatch, capsys):
    out = tmp_path / "report.md"
    args = ["--store", store[0].root, "evaluate", "--definitions", str(definitions), "--format", "modern", "--game", "cards", "--start", "2024-03-01", "--end", "2024-03-30"]
    args += ["--release", f"set|New|Card {KEY_CARD}|2024-03-01", "--established", "20", "--out", str(out), "--date", "2024-04-01"]
    assert cli.main(args) == 0
    text = out.read_text()
    assert "| made twice | equal | equal | pass |" in text and "| new kinds found | 1 of 1 | all | pass |" in text
    shown = json.loads(capsys.readouterr().out)
    assert shown["holdout"]["agreement"] == f"{float(shown['holdout']['agreement']):.6f}" and shown["releases"][0]["passed"]
    # Something that depends on chance.
    calls = iter(range(100))
    monkeypatch.setattr(holdout, "holdout", lambda *a, **k: holdout.Holdout(next(calls), 0, 0, 0, 0, 0, 0.0, 0.0, ()))
    monkeypatch.setattr(holdout, "blind", lambda *a, **k: evaluate.Emergence(0))
    assert cli.main(args) == 2 and "| made twice | different | equal | fail |" in out.read_text()


def test_digits_round_the_stored_number():
    found = holdout.Evaluation(holdout.Holdout(1, 1, 0, 0, 1, 0, 0.0000005, 0.1234565, ()), (), {})
    shown = json.loads(holdout.digits(found))["holdout"]
    assert (shown["agreement"], shown["rand_index"]) == (f"{0.0000005:.6f}", f"{0.1234565:.6f}")
