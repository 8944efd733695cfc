"""Queries of the canonical tables on disk, of import gates, reports and digests, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate, importer, normalize, quality
from ..operators.numbering import shared_dir
from ..schemas import TABLES
from ..sources.definitions import Format
from ..sources.events import select_events
from ..sources.tables import Store
from . import star
from .catalog import TODAY, query

#: A day on which some events are still to come.
DAY = "1995-03-01"


def _store(s):
    return Store(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")


@query(star.DOCUMENTS_SQL + "SELECT raw_ref, id, first_deck FROM num", star_sql=False)
def q_event_numbers(s, d):
    """Ids of events and of their first decks, both without gaps, in the order of paths."""
    chosen, _ = select_events(star.documents(s, d), star.TOKENS, star.WANTED)
    return normalize.number_events(chosen).select("raw_ref", "id", "first_deck")


@query("SELECT id, game_id, canonical_ref, name, type_line, list_aggregate(face_names, 'string_agg', ',') AS faces FROM cards")
def q_card_store(s, d):
    """Cards that were loaded into a store, which takes no second catalogue."""
    store = _store(s)
    store.load_cards(star.cards(s, d))
    try:
        store.load_cards(star.cards(s, d))
        raise AssertionError("a second catalogue was taken")
    except RuntimeError:
        pass
    return store.read("cards").select("id", "game_id", "canonical_ref", "name", "attrs.type_line", F.array_join("attrs.face_names", ",").alias("faces"))


@query("SELECT g.name AS game, f.name AS format, CAST(CASE WHEN f.id % 2 = 0 THEN 99 ELSE 60 END AS INTEGER) AS expected_mainboard_min, dense_rank() OVER (ORDER BY g.name) AS game_no FROM formats f JOIN games g ON g.id = f.game_id")
def q_store_settings(s, d):
    """Games and formats that were written twice, the second time with other settings; ids stay."""
    store = _store(s)
    rows = star.formats(s, d).join(star.games(s, d).select(F.col("id").alias("game_id"), F.col("name").alias("game")), "game_id").orderBy("game", "name").collect()
    for later in (False, True):
        for game in sorted({r["game"] for r in rows}):
            store.swap("games", importer.game_rows(store, game))
            game_id = store.read("games").where(F.col("name") == game).first()["id"]
            own = [Format(game, r["name"], True, (r["name"].lower(),), expected_mainboard_min=99 if later and r["id"] % 2 == 0 else 60) for r in rows if r["game"] == game]
            store.swap("formats", importer.format_rows(store, own, game_id))
    games = store.read("games").select(F.col("id").alias("game_id"), F.col("name").alias("game"))
    found = store.read("formats").join(games, "game_id")
    return found.select("game", F.col("name").alias("format"), "config.expected_mainboard_min", F.col("game_id").cast("long").alias("game_no"))


@query(
    f", kept AS (SELECT * FROM ev WHERE event_type IS NOT NULL) SELECT name || ': ' || n AS problem FROM (SELECT 'events dated in the future' AS name, count(*) AS n FROM kept WHERE date > DATE '{DAY}' "
    "UNION ALL SELECT 'decks -> events', count(*) FROM decks d WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.id = d.event_id) "
    "UNION ALL SELECT 'deck_cards with count < 1', count(*) FROM deck_cards WHERE count < 1) WHERE n > 0"
)
def q_gate_problems(s, d):
    """What the gates of an import say on an early day, of all tables if events without a type were not imported."""
    tables = star.tables(s, d) | {"events": star.events(s, d).where("event_type is not null")}
    return s.createDataFrame([(p,) for p in quality.gate_problems(tables, F.lit(DAY).cast("date"))], "problem string")


_SECTIONS = {"Events and decks by year and source": "1", "Events and decks by type": "2", "Record coverage": "3"}


@query(
    ", a AS (SELECT CAST(extract(year FROM e.date) AS INTEGER) AS year, source, count(DISTINCT e.id) AS events, count(d.id) AS decks FROM ev e LEFT JOIN decks d ON d.event_id = e.id GROUP BY 1, 2), "
    "b AS (SELECT coalesce(event_type, '(null)') AS event_type, count(DISTINCT e.id) AS events, count(d.id) AS decks FROM ev e LEFT JOIN decks d ON d.event_id = e.id GROUP BY 1), "
    "c AS (SELECT source, event_type, count(wins) AS r, count(*) AS n FROM ev e JOIN decks d ON d.event_id = e.id GROUP BY 1, 2) "
    "SELECT '1' AS section, row_number() OVER (ORDER BY year NULLS FIRST, source) AS line_no, '| ' || coalesce(CAST(year AS VARCHAR), 'None') || ' | ' || source || ' | ' || events || ' | ' || decks || ' |' AS line FROM a "
    "UNION ALL SELECT '2', row_number() OVER (ORDER BY events DESC, event_type), '| ' || event_type || ' | ' || events || ' | ' || decks || ' |' FROM b "
    "UNION ALL SELECT '3', row_number() OVER (ORDER BY source, event_type NULLS LAST), '| ' || source || ' | ' || coalesce(event_type, 'None') || ' | ' || r || ' | ' || n || ' |' FROM c"
)
def q_report_lines(s, d):
    """Lines of three sections of the Markdown report, with their places."""
    tables = star.tables(s, d)
    others = {
        "ingest_unresolved_cards": star.unresolved(s, d).select(F.lit(1).alias("id"), "card_name", "occurrences", "decks_affected"),
        **{t: s.createDataFrame([], TABLES[t]) for t in ("archetypes", "archetype_labels", "matches")},
    }
    out = []
    for part in quality.report(tables | others, TODAY, F.lit(TODAY).cast("date")).split("\n\n## ")[1:]:
        title, *lines = part.strip().split("\n")
        if title in _SECTIONS:
            body = [x for x in lines if x.startswith("|")][2:]
            out += [(_SECTIONS[title], n + 1, line) for n, line in enumerate(body)]
    return s.createDataFrame(out, "section string, line_no long, line string")


@query(
    ", h AS (SELECT sha256(CAST(to_json({'event_id': event_id, 'id': id, 'losses': losses, 'player': player, 'wins': wins}) AS VARCHAR)) AS h FROM decks) SELECT count(*) AS n, "
    + ", ".join(f"CAST(sum(CAST(CAST(('0x' || substr(h, {15 * k + 1}, 15)) AS BIGINT) AS DECIMAL(38, 0))) AS DECIMAL(38, 0)) AS s{k}" for k in range(4)) + " FROM h"
)
def q_digest(s, d):
    """The sums that a digest of all decks is made from."""
    return evaluate.digest_sums(star.decks(s, d).select("id", "event_id", "player", "wins", "losses"))
