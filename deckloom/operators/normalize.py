"""Event documents to events, decks and card lines by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .numbering import numbered

RECORD = {"finish_rank": "$.Rank", "wins": "$.Wins", "losses": "$.Losses", "draws": "$.Draws"}


def _decks() -> Column:
    return F.coalesce(F.size("Decks"), F.lit(0))


def with_standings(docs: DataFrame) -> DataFrame:
    """Adds _standings: a map from player to that player's last standing; those without a player are left out.

    Players are sorted with their places, so the last one of each is that before another player.
    """
    player = lambda s: F.variant_get(s, "$.Player", "string")
    all_ = F.coalesce("Standings", F.expr("array()").cast("array<variant>"))
    named = docs.withColumn("_named", F.filter(all_, lambda s: player(s).isNotNull()))
    placed = F.transform("_named", lambda s, k: F.struct(player(s).alias("p"), k.alias("k")))
    ordered = named.withColumn("_ordered", F.array_sort(placed))
    last = F.filter("_ordered", lambda x, k: (k == F.size("_ordered") - 1) | (F.get("_ordered", k + 1)["p"] != x["p"]))
    pairs = ordered.withColumn("_last", last)
    found = F.map_from_entries(F.transform("_last", lambda x: F.struct(x["p"], F.get("_named", x["k"]))))
    return pairs.withColumn("_standings", found).drop("_named", "_ordered", "_last")


def override(standing: Column, path: str, parsed: Column) -> Column:
    """The standing's field: absent leaves what was parsed, a null one gives null."""
    return F.when(standing.isNull() | F.variant_get(standing, path, "variant").isNull(), parsed).otherwise(
        F.try_variant_get(standing, path, "int")
    )


def number_events(docs: DataFrame, first_id: int = 1, first_deck_id: int = 1) -> DataFrame:
    """Adds id and first_deck (the id of the event's first deck), both without gaps in path order.

    Only events are counted, one small row each, never decks, and those in ranges.
    """
    small = docs.select("raw_ref", "path", _decks().alias("n"))
    placed = numbered(small, ["path"], "id", {"first_deck": "n"}).select(
        "raw_ref", (F.col("id") + (first_id - 1)).alias("id"), (F.col("first_deck") + first_deck_id).alias("first_deck")
    )
    return docs.join(placed, "raw_ref")


def events(placed: DataFrame, game_id: int, format_ids: dict[str, int]) -> DataFrame:
    """The ``events`` table, with counters: standings_only, decks_without_standing."""
    pairs = [F.lit(x) for kv in sorted(format_ids.items()) for x in kv]
    deck_players = F.transform(F.coalesce("Decks", F.array().cast(placed.schema["Decks"].dataType)), lambda d: d["Player"])
    n = F.size("_players")
    return (
        with_standings(placed)
        .withColumn("_players", F.map_keys("_standings"))
        .withColumn("_deck_players", deck_players)
        .select(
            "id",
            F.lit(game_id).alias("game_id"),
            "source",
            F.col("slug").alias("source_event_id"),
            F.element_at(F.create_map(*pairs), F.col("format")).alias("format_id"),
            F.col("Tournament.Name").alias("name"),
            text.event_date(F.col("Tournament.Date"), F.col("path_date")).alias("date"),
            text.event_type(F.col("source"), F.col("slug")).alias("event_type"),
            F.when(n > 0, n).otherwise(_decks()).alias("player_count"),
            "raw_ref",
            F.size(F.array_except("_players", F.array_compact("_deck_players"))).alias("standings_only"),
            F.when(
                n > 0,
                F.size(F.filter("_deck_players", lambda p: p.isNull() | ~F.array_contains(F.col("_players"), F.coalesce(p, F.lit(""))))),
            )
            .otherwise(0)
            .alias("decks_without_standing"),
        )
    )


def decks(placed: DataFrame) -> DataFrame:
    """The ``decks`` table, and the documents' card lines as ``lines``. One pass, no shuffle.

    Each deck takes its own standing out of the map, so an event's standings are never copied.
    """
    own = F.transform("Decks", lambda d: F.struct(d.alias("deck"), F.when(d["Player"].isNotNull(), F.element_at("_standings", d["Player"])).alias("own")))
    rows = with_standings(placed).select("id", "first_deck", F.posexplode(own).alias("pos", "x"))
    rows = rows.select("id", "first_deck", "pos", F.col("x.deck").alias("deck"), F.col("x.own").alias("_own"))
    rows = rows.withColumn("_parsed", text.parse_result(F.nullif(F.col("deck.Result"), F.lit(""))))

    def zone(lines: str, board: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"deck.{lines}"), F.array().cast("array<struct<CardName:string,Count:int>>")),
            lambda c: F.struct(c["CardName"].alias("name"), c["Count"].alias("count"), F.lit(board).alias("board")),
        )

    return rows.select(
        (F.col("first_deck") + F.col("pos")).cast("long").alias("id"),
        F.col("id").alias("event_id"),
        F.col("deck.Player").alias("player"),
        *[override(F.col("_own"), path, F.col(f"_parsed.{c}")).alias(c) for c, path in RECORD.items()],
        F.lit(None).cast("int").alias("archetype_id"),
        F.lit(None).cast("string").alias("classifier_version"),
        F.concat(zone("Mainboard", "main"), zone("Sideboard", "side")).alias("lines"),
    )


def card_lines(deck_rows: DataFrame) -> DataFrame:
    """(deck_id, name, board, count): counts of equal names in a zone summed, also those below one."""
    flat = deck_rows.select(F.col("id").alias("deck_id"), F.explode("lines").alias("x")).select("deck_id", "x.*")
    return flat.groupBy("deck_id", "name", "board").agg(F.sum("count").cast("int").alias("count"))
