"""Imports event documents into the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import TABLES
from ..sources.definitions import Format
from ..sources.events import read_events, select_events
from ..sources.tables import Store, insert_absent, upsert, upsert_additive
from . import normalize, quality, resolve
from .numbering import cut

#: What is counted of each table while it is written, as SQL.
COUNTED = {
    "events": {
        "events": "count(1)", "standings_only_players": "coalesce(sum(standings_only), 0)",
        "decks_without_standing": "coalesce(sum(decks_without_standing), 0)",
    },
    "decks": {"decks": "count(1)"},
    "deck_cards": {"deck_cards": "count(1)"},
}


@dataclass(frozen=True)
class ImportResult:
    """Counts of an import, by name."""

    counts: dict[str, int]

    def summary(self) -> str:
        return "\n".join(f"{name}: {n}" for name, n in self.counts.items())


def with_ids(old: DataFrame, fresh: list[tuple], key: int) -> list[tuple]:
    """Rows of a small table (id first) with ids: those of a key that ``old`` has keep its id, others follow the largest one.

    old: id and, in one column ``key``, what identifies a row. Such tables are as
    long as the settings, so the driver holds them.
    """
    known = {r["key"]: r["id"] for r in old.collect()}
    free = max(known.values(), default=0)
    out = []
    for row in fresh:
        if row[key] not in known:
            free += 1
            known[row[key]] = free
        out.append((known[row[key]], *row[1:]))
    return out


def game_rows(store: Store, game: str) -> DataFrame:
    """The ``games`` table with the game in it."""
    old = store.read("games")
    fresh = with_ids(old.select("id", F.col("name").alias("key")), [(None, game)], 1)
    return insert_absent(old, store.spark.createDataFrame(fresh, TABLES["games"]), ["name"])


def format_rows(store: Store, formats: list[Format], game_id: int) -> DataFrame:
    """The ``formats`` table with the settings' formats of a game: new ones get new ids, others new settings."""
    old = store.read("formats")
    mine = old.where(F.col("game_id") == game_id).select("id", F.col("name").alias("key"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).select("id", F.lit(None).cast("string").alias("key"))
    rows = [
        (
            None, game_id, f.name,
            (list(f.slug_tokens), list(f.board_zones), f.expected_mainboard_min, f.expected_sideboard_max, list(f.vector_exclude_type_line_prefixes)),
        )
        for f in formats
    ]
    fresh = store.spark.createDataFrame(with_ids(mine.unionByName(top), rows, 2), TABLES["formats"])
    return upsert(old, fresh, ["game_id", "name"], ["config"])


def normalized(docs: DataFrame, cards: DataFrame, game_id: int, format_ids: dict[str, int]) -> dict[str, DataFrame]:
    """Events, decks, deck_cards, and the lines without a card, of selected documents."""
    placed = cut(normalize.number_events(docs))
    events, decks = normalize.events(placed, game_id, format_ids), cut(normalize.decks(placed))
    lines = cut(normalize.card_lines(decks))
    names = cut(resolve.resolve_names(lines, cards.where(F.col("game_id") == game_id)))
    deck_cards, missed = resolve.resolve_lines(lines, names)
    return {"events": events, "decks": decks, "lines": lines, "deck_cards": deck_cards, "missed": missed}


def run_import(
    store: Store,
    root: str,
    formats: list[Format],
    game: str,
    only_formats: set[str] | None = None,
    today=None,
    skip_broken: bool = False,
) -> ImportResult:
    """Reads the documents below ``root``, writes games, formats, events, decks, deck_cards and unresolved names, and checks them.

    Raises RuntimeError if there are no cards yet. Events and decks are replaced;
    occurrences of unresolved names add up over imports. The documents are parsed once.
    New tables stand beside the old ones until they pass the checks; if one fails, a
    ValueError is raised and the old tables stay as they were. So it is if a document could not be parsed,
    unless ``skip_broken`` has such documents counted and left out. Counts are taken while tables are written.
    """
    spark = store.spark
    cards = store.read("cards")
    if cards.isEmpty():
        raise RuntimeError("there are no cards; load a catalogue first")
    own = [f for f in formats if f.game == game]
    wanted = {f.name for f in own if f.imported} & (only_formats if only_formats is not None else {f.name for f in own})
    store.swap("games", game_rows(store, game))
    game_id = store.read("games").where(F.col("name") == game).first()["id"]
    store.swap("formats", format_rows(store, own, game_id))
    ids = {r["name"]: r["id"] for r in store.read("formats").where(F.col("game_id") == game_id).collect()}

    given = cut(read_events(spark, root))
    tokens = {f.name: list(f.slug_tokens) for f in own}
    docs, skipped = select_events(given, tokens, wanted)
    counts = skipped.first().asDict()
    if counts["broken"] and not skip_broken:
        some = [r["raw_ref"] for r in given.where("broken").where(text.detect_format(F.col("slug"), tokens).isin(sorted(wanted))).select("raw_ref").orderBy("raw_ref").limit(5).collect()]
        raise ValueError(f"{counts['broken']} documents could not be parsed: {', '.join(some)}")
    made = normalized(docs, cards, game_id, ids)
    beside = {}
    try:
        for name, rows in (("events", made["events"]), ("decks", made["decks"]), ("deck_cards", made["deck_cards"])):
            beside[name], seen = store.stage(name, rows, COUNTED[name])
            counts |= seen
        staged = {name: store.staged(name, path) for name, path in beside.items()}
        quality.gates({n: store.read(n) for n in ("games", "formats", "cards")} | staged, today)
    except ValueError:
        for path in beside.values():
            store.drop(path)
        raise
    counts["zero_count_lines"], missed = made["lines"].where("count < 1").count(), made["missed"]
    counts |= missed.agg(F.count_distinct("name").alias("unresolved_names"), F.count_distinct("deck_id").alias("decks_with_unresolved")).first().asDict()
    report = resolve.unresolved_report(missed, staged["decks"], staged["events"])
    keys, add = ["game_id", "format_id", "card_name"], ["occurrences", "decks_affected"]
    summed = resolve.numbered_unresolved(upsert_additive(store.read("ingest_unresolved_cards"), report, keys, add))
    beside["ingest_unresolved_cards"], _ = store.stage("ingest_unresolved_cards", summed)
    for name, path in beside.items():
        store.put(name, path)
    return ImportResult(counts)


def _tables(given: Store | dict[str, DataFrame]) -> dict[str, DataFrame]:
    return given if isinstance(given, dict) else {n: given.read(n) for n in ("games", "formats", "events", "decks", "deck_cards")}


def window_decks(given: Store | dict[str, DataFrame], start, end, format_name: str, game: str | None = None) -> DataFrame:
    """(deck_id, date) of a format's decks between two days, both included, also those without a card.

    The date filter reaches the event scan, and events are laid out by format. Raises ValueError if
    several games have a format of this name and none of them is named.
    """
    tables = _tables(given)
    chosen = tables["formats"].where(F.col("name") == format_name)
    if game is not None:
        chosen = chosen.join(F.broadcast(tables["games"].where(F.col("name") == game).select(F.col("id").alias("game_id"))), "game_id", "left_semi")
    elif chosen.select("game_id").distinct().limit(2).count() > 1:
        raise ValueError(f"several games have a format {format_name!r}; name one of them")
    # The format table has a row for each format.
    events = tables["events"].where(F.col("date").between(F.lit(start), F.lit(end))).join(
        F.broadcast(chosen.select(F.col("id").alias("format_id"))), "format_id", "left_semi"
    )
    decks = tables["decks"].select(F.col("id").alias("deck_id"), "event_id")
    return decks.join(events.select(F.col("id").alias("event_id"), "date"), "event_id").select("deck_id", "date")


def load_window(given: Store | dict[str, DataFrame], start, end, format_name: str, game: str | None = None) -> DataFrame:
    """(deck_id, date, card_id, count, board) of the cards of ``window_decks``.

    A given ``deck_cards`` may be a function that makes the cards of some decks (deck_id), where those of all would be much more.
    """
    tables = _tables(given)
    decks, cards = window_decks(tables, start, end, format_name, game), tables["deck_cards"]
    if callable(cards):
        decks = cut(decks)
        cards = cards(decks)
    return cards.join(decks, "deck_id").select("deck_id", "date", "card_id", "count", "board")
