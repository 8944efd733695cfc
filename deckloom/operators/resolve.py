"""Names to card ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .numbering import numbered

#: How some sources join the halves of a name, and how the catalogue does.
WRITTEN, CANONICAL = " && ", " // "


def name_index(cards: DataFrame) -> DataFrame:
    """(name, card_id, place): every full name and face name once.

    Of equal full names the smallest card wins, a full name wins over a face, and of
    equal faces the smallest card wins. place orders the names: full names by card,
    then faces by card and place among its faces.
    """
    full = cards.select("name", F.col("id").alias("card_id"), F.struct(F.lit(0).alias("kind"), "id", F.lit(0).alias("pos")).alias("place"))
    faces = cards.select("id", F.posexplode("attrs.face_names").alias("pos", "name")).select(
        "name", F.col("id").alias("card_id"), F.struct(F.lit(1).alias("kind"), "id", "pos").alias("place")
    )
    return (
        full.unionByName(faces)
        .where("name is not null")
        .groupBy("name")
        .agg(F.min(F.struct("place", "card_id")).alias("x"))
        .select("name", "x.card_id", "x.place")
    )


def resolve_names(names: DataFrame, cards: DataFrame, fold: Callable = text.casefold) -> DataFrame:
    """(name, card_id) for every distinct name; a null card_id if nothing fits.

    An exact name comes first, then one that differs in case only (of several the
    first in place), then both again with the separator that the catalogue uses.
    Works on distinct names, so its joins stay small beside the rows that hold them.
    """
    index = name_index(cards)
    cased = index.withColumn("key", fold("name")).groupBy("key").agg(F.min(F.struct("place", "card_id")).alias("x")).select("key", F.col("x.card_id").alias("by_case"))
    asked = names.select("name").where("name is not null").distinct()
    spelled = asked.withColumn("other", F.replace("name", F.lit(WRITTEN), F.lit(CANONICAL)))
    tries = spelled.select("name", F.lit(0).alias("try"), F.col("name").alias("asked")).unionByName(
        spelled.where("other <> name").select("name", F.lit(1).alias("try"), F.col("other").alias("asked"))
    )
    found = (
        tries.withColumn("key", fold("asked"))
        .join(index.select(F.col("name").alias("asked"), "card_id"), "asked", "left")
        .join(cased, "key", "left")
        .withColumn("card", F.coalesce("card_id", "by_case"))
    )
    best = F.min(F.when(F.col("card").isNotNull(), F.struct("try", "card")))
    return found.groupBy("name").agg(best.alias("x")).select("name", F.col("x.card").alias("card_id"))


def fold_index(cards: DataFrame, key=text.fold_name) -> DataFrame:
    """(key, card_id): folded full names that belong to one card only. Distinct names are folded, not all rows."""
    names = cards.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return (
        names.select(key("name").alias("key"), "least", "most")
        .groupBy("key")
        .agg(F.min("least").alias("card_id"), F.max("most").alias("_other"))
        .where("card_id = _other and key is not null")
        .select("key", "card_id")
    )


def resolve_lines(lines: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Card lines (deck_id, name, board, count) to deck_cards, and the lines without a card.

    Lines of a sum below one are left out before. Two names of one card are summed.
    """
    kept = lines.where("count >= 1").join(names, "name", "left")
    good = kept.where("card_id is not null").groupBy("deck_id", "card_id", "board").agg(F.sum("count").cast("int").alias("count"))
    return good.select("deck_id", "card_id", "count", "board"), kept.where("card_id is null").drop("card_id")


def unresolved_report(missed: DataFrame, decks: DataFrame, events: DataFrame) -> DataFrame:
    """(game_id, format_id, card_name, occurrences, decks_affected) of the lines without a card."""
    placed = missed.join(decks.select(F.col("id").alias("deck_id"), "event_id"), "deck_id").join(
        events.select(F.col("id").alias("event_id"), "game_id", "format_id"), "event_id"
    )
    return placed.groupBy("game_id", "format_id", F.col("name").alias("card_name")).agg(
        F.count("*").cast("int").alias("occurrences"), F.count_distinct("deck_id").cast("int").alias("decks_affected")
    )


def numbered_unresolved(report: DataFrame) -> DataFrame:
    """The report as a table with ids, in order of game, format and name; it has a row for each name, not for each line."""
    return numbered(report, ["game_id", "format_id", "card_name"])
