from __future__ import annotations

import json
import random

import duckdb
import pytest

from deckloom.functions.text import COLOR_NAMES
from deckloom.operators import rules
from deckloom.sources.definitions import (
    CONDITIONS,
    Audit,
    Condition,
    Definitions,
    Fallback,
    Rule,
    fold_index,
    load_definitions,
    relaxed_json,
)


def frame(spark, decks):
    rows = [(d, c, n, b) for d, zones in decks.items() for b, cards in zones.items() for c, n in cards.items()]
    return spark.createDataFrame(rows, "deck_id long, card_id long, count int, board string")


@pytest.mark.parametrize(
    "kind, cards, listed, want",
    [
        ("InMainboard", [1], 1, True),
        ("InMainboard", [3], 1, False),
        ("InSideboard", [3], 1, True),
        ("InSideboard", [1], 1, False),
        ("InMainOrSideboard", [3], 1, True),
        ("OneOrMoreInMainboard", [5, 6, 1], 3, True),
        ("OneOrMoreInMainboard", [5, 6], 2, False),
        ("TwoOrMoreInMainboard", [1, 2], 2, True),
        ("TwoOrMoreInMainboard", [1, 5], 2, False),
        ("TwoOrMoreInMainOrSideboard", [1, 3], 2, True),
        ("DoesNotContain", [5], 1, True),
        ("DoesNotContain", [3], 1, False),
        ("DoesNotContainMainboard", [3], 1, True),
        ("DoesNotContainSideboard", [1], 1, True),
        ("InMainboard", [], 1, False),
        ("OneOrMoreInMainboard", [], 3, False),
        ("DoesNotContain", [], 1, True),
        ("InMainboard", [], 0, True),
    ],
)
def test_conditions(spark, kind, cards, listed, want):
    decks = {1: {"main": {1: 4, 2: 1}, "side": {3: 2}}}
    defs = Definitions("f", (Rule("R", False, (Condition(kind, tuple(cards), listed),)),))
    got = rules.rule_matches(frame(spark, decks), rules.compile_rules(spark, defs)).count() == 1
    assert got == want


#: What a rule set says, as questions to tables of facts.
#: zone(deck, card, n, side), rule(id, parent, place, name, outer, tinted, conds), need(cond, rule, at_least, forbids, empty, main, side),
#: listed(cond, card) with a row for each mention, pile(id, name, tinted, size), piled(pile, card), tint(card, land, letter), guild(letters, name).
SAYS = r"""
WITH deck AS (SELECT deck, count(*) AS entries FROM zone GROUP BY deck),
told AS (SELECT z.deck, l.cond, count(*) FILTER (CASE WHEN z.side THEN n.side ELSE n.main END) AS seen
         FROM zone z JOIN listed l USING (card) JOIN need n USING (cond) GROUP BY ALL),
broken AS (SELECT DISTINCT d.deck, n.rule FROM deck d CROSS JOIN need n LEFT JOIN told t ON t.deck = d.deck AND t.cond = n.cond
           WHERE NOT n.empty AND CASE WHEN n.forbids THEN coalesce(t.seen, 0) > 0 ELSE coalesce(t.seen, 0) < n.at_least END),
fits AS (SELECT d.deck, r.* FROM deck d CROSS JOIN rule r ANTI JOIN broken b ON b.deck = d.deck AND b.rule = r.id),
hit AS (SELECT f.*, up.deck IS NOT NULL AS beneath, down.deck IS NOT NULL AS above FROM fits f
        LEFT JOIN fits up ON up.deck = f.deck AND up.id = f.parent LEFT JOIN (SELECT DISTINCT deck, parent FROM fits) down ON down.deck = f.deck AND down.parent = f.id),
counts AS (SELECT * FROM hit WHERE CASE WHEN parent IS NULL THEN NOT above ELSE beneath END),
hue AS (SELECT deck, string_agg(letter, '' ORDER BY position(letter IN 'WUBRG')) AS letters FROM
        (SELECT deck, letter FROM zone JOIN tint USING (card) GROUP BY ALL HAVING count(DISTINCT land) = 2) GROUP BY deck),
shade AS (SELECT deck, entries, coalesce(letters, 'C') AS color FROM deck LEFT JOIN hue USING (deck)),
calls AS (SELECT 'rules' AS method, c.deck, c.outer, CASE WHEN c.parent IS NOT NULL THEN c.name END AS variant, c.name, c.tinted, 1.0::DOUBLE AS sure,
                 rank() OVER (PARTITION BY c.deck ORDER BY c.conds, c.place) AS rank, c.place FROM counts c
          UNION ALL
          SELECT 'fallback', deck, name, NULL, name, tinted, held / entries, rank() OVER (PARTITION BY deck ORDER BY held DESC, size, id), id
          FROM (SELECT z.deck, p.id, p.name, p.tinted, p.size, sum(z.n)::DOUBLE AS held FROM zone z JOIN piled USING (card) JOIN pile p ON p.id = piled.pile GROUP BY ALL)
          JOIN deck USING (deck) WHERE deck NOT IN (SELECT deck FROM counts)),
worded AS (SELECT calls.*, color, trim(regexp_replace(regexp_replace(
             CASE WHEN tinted THEN coalesce(guild.name, '') ELSE '' END || replace(calls.name, 'Generic', ''),
             '([A-Z])(?:([A-Z][a-z]))|([^A-Z ])([A-Z])', '\1\3 \2\4', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')) AS label
           FROM calls JOIN shade USING (deck) LEFT JOIN guild ON guild.letters = color),
several AS (SELECT deck, list(label ORDER BY place) AS labels FROM worded WHERE method = 'rules' GROUP BY deck HAVING count(*) > 1)
SELECT shade.deck, w.outer, w.variant, w.label, w.method, w.sure, shade.color, coalesce(labels, []) AS labels
FROM shade LEFT JOIN (SELECT * FROM worded WHERE rank = 1 AND (method = 'rules' OR sure > 0.1)) w USING (deck) LEFT JOIN several USING (deck)
"""


def said(decks, defs):
    """Decks classified by the questions above."""
    con = duckdb.connect()

    def table(name, columns, rows):
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)

    table("zone", "deck INT, card INT, n INT, side BOOL", [(d, c, n, z == "side") for d, zones in decks.items() for z, cards in zones.items() for c, n in cards.items()])
    flat = [(None, None, r) for r in defs.rules]
    flat = [x for _, _, r in flat for x in ((None, r), *((r, v) for v in r.variants))]
    ids = {id(r): k for k, (_, r) in enumerate(flat)}
    table("rule", "id INT, parent INT, place INT, name TEXT, \"outer\" TEXT, tinted BOOL, conds INT", [
        (k, None if up is None else ids[id(up)], k, r.name, (up or r).name, r.with_color, len(r.conditions) + (len(up.conditions) if up else 0)) for k, (up, r) in enumerate(flat)
    ])
    conds = [(k, c) for k, (_, r) in enumerate(flat) for c in r.conditions]
    wanted = {kind: (least, no, main, side) for kind, (main, side, least, no) in CONDITIONS.items()}
    table("need", "cond INT, rule INT, at_least INT, forbids BOOL, empty BOOL, main BOOL, side BOOL", [
        (n, k, wanted[c.kind][0], wanted[c.kind][1], c.listed == 0, *map(bool, wanted[c.kind][2:])) for n, (k, c) in enumerate(conds)
    ])
    table("listed", "cond INT, card INT", [(n, card) for n, (_, c) in enumerate(conds) for card in c.cards])
    table("pile", "id INT, name TEXT, tinted BOOL, size INT", [(k, f.name, f.with_color, len(f.cards)) for k, f in enumerate(defs.fallbacks)])
    table("piled", "pile INT, card INT", [(k, c) for k, f in enumerate(defs.fallbacks) for c in set(f.cards)])
    table("tint", "card INT, land BOOL, letter TEXT", [(c, land, x) for land, t in ((True, defs.land_colors), (False, defs.nonland_colors)) for c, xs in t.items() for x in xs])
    table("guild", "letters TEXT, name TEXT", list(COLOR_NAMES.items()))
    return {row[0]: row[1:] for row in con.execute(SAYS.replace("c.outer", 'c."outer"').replace("w.outer", 'w."outer"')).fetchall()}


@pytest.mark.parametrize("seed", range(3))
def test_classify_like_the_rules_read(spark, seed):
    rng = random.Random(seed)

    def condition():
        cards = tuple(rng.choices(range(12), k=rng.choice([0, 1, 1, 2, 3])))
        return Condition(rng.choice(list(CONDITIONS)), cards, len(cards) + rng.choice([0, 0, 1]))

    def rule(k, depth=0):
        variants = tuple(rule(f"{k}V{j}", 1) for j in range(rng.choice([0, 0, 1, 2]))) if not depth else ()
        return Rule(f"Generic{k}Deck", rng.random() < 0.5, tuple(condition() for _ in range(rng.choice([0, 1, 2, 2, 3]) if k == "R0" else rng.choice([1, 2, 3]))), variants)

    defs = Definitions(
        "f",
        tuple(rule(f"R{k}") for k in range(8)),
        tuple(Fallback(f"Fall{k}", k == 1, tuple(rng.choices(range(14), k=3 + k))) for k in range(3)),
        {c: rng.choice(["W", "U", "BR", ""]) for c in range(0, 12, 2)},
        {c: rng.choice(["W", "UB", "R", "WUBRG"]) for c in range(1, 12, 2)},
    )
    decks = {}
    for d in range(150):
        zones = {b: {c: rng.randint(1, 4) for c in rng.sample(range(16), rng.randint(0, 6))} for b in ("main", "side")}
        if zones["main"] or zones["side"]:
            decks[d] = zones
    got = {r["deck_id"]: tuple(r)[1:] for r in rules.classify(frame(spark, decks), rules.compile_rules(spark, defs)).collect()}
    assert got == said(decks, defs)


def test_no_rules_and_no_decks(spark):
    nothing = rules.compile_rules(spark, Definitions("f", ()))
    rows = rules.classify(frame(spark, {1: {"main": {1: 1}}}), nothing).collect()
    assert [tuple(r) for r in rows] == [(1, None, None, None, None, None, "C", [])]
    empty = spark.createDataFrame([], "deck_id long, card_id long, count int, board string")
    assert rules.classify(empty, nothing).count() == 0


def test_relaxed_json():
    assert relaxed_json('﻿{"a": [1,2,],}') == {"a": [1, 2]}
    assert relaxed_json('{"a": ",]"}') == {"a": ",]"}
    with pytest.raises(ValueError):
        relaxed_json("[1]")


def test_load_definitions(tmp_path):
    here = tmp_path / "modern"
    (here / "Archetypes").mkdir(parents=True)
    (here / "Fallbacks").mkdir()
    rule = {
        "Name": "Aggro", "IncludeColorInName": True, "Conditions": [{"Type": "InMainboard", "Cards": ["Bolt", "Ice"]}, {"Type": "DoesNotContain", "Cards": ["Gone"]}],
        "Variants": [{"Name": "Red", "Conditions": None}],
    }
    (here / "Archetypes/Aggro.json").write_text(json.dumps(rule))
    (here / "Archetypes/Other.json").write_text('{"Name": "Other", "Conditions": [{"Type": "TwoOrMoreInSideboard", "Cards": ["Ice", "Dûl"]}]}')
    (here / "Fallbacks/Pile.json").write_text('{"Name": "Pile", "CommonCards": ["Bolt", "Gone"]}')
    (tmp_path / "card_colors.json").write_text('{"Lands": [{"Name": "Ice", "Color": "U"}], "NonLands": [{"Name": "Bolt", "Color": "R"}, {"Name": "Gone", "Color": "G"}]}')
    (here / "color_overrides.json").write_text('{"Lands": [{"Name": "Ice", "Color": "W"},], "NonLands": null}')
    known, audit = {"Bolt": 1, "Ice": 2}.get, Audit()
    defs = load_definitions(tmp_path, "modern", known, fold_index([("Dul", 3), ("x", 4), ("X", 5)]), audit=audit)
    aggro, other = defs.rules
    assert aggro.conditions == (Condition("InMainboard", (1,), 1), Condition("DoesNotContain", (), 1)) and aggro.variants[0].conditions == ()
    assert other.conditions[0].cards == (2, 3) and defs.fallbacks[0].cards == (1,)
    assert (defs.land_colors, defs.nonland_colors) == ({2: "W"}, {1: "R"})
    assert audit.by_fold == {"Dûl": 3} and audit.unresolved == ["Gone", "Gone"]
    without = load_definitions(tmp_path, "modern", known, without=frozenset({"Other"}))
    assert len(without.rules) == 1 and without.version != defs.version and defs.version.startswith("rules-")
    (here / "Archetypes/Bad.json").write_text('{"Name": "Bad", "Conditions": [{"Type": "Maybe", "Cards": []}]}')
    with pytest.raises(ValueError, match="Maybe"):
        load_definitions(tmp_path, "modern", known)


def test_fold_index():
    assert fold_index([("Æ", 1), ("æ", 1), ("é", 2), ("E", 3)]) == {"æ": 1, "e": None}
