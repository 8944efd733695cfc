"""Decks as TF-IDF vectors in long form: one row for each deck and card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import starts_with_any


def excluded_cards(cards: DataFrame, prefixes: list[str]) -> DataFrame:
    """(card_id) of the cards whose type line starts with one of the prefixes."""
    return cards.where(starts_with_any(F.col("attrs.type_line"), prefixes)).select(F.col("id").alias("card_id"))


def inverse_frequencies(entries: DataFrame, n_decks: int) -> DataFrame:
    """(card_id, idf): ln((1 + decks) / (1 + decks with the card)) + 1."""
    n = F.lit(float(max(n_decks, 1)))
    return entries.groupBy("card_id").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))


def tf_idf(deck_cards: DataFrame, decks: DataFrame, excluded: DataFrame | None = None, board: str = "main") -> DataFrame:
    """(deck_id, card_id, weight): copies x idf of a zone, scaled to length one for each deck.

    ``decks`` (deck_id) are all decks, also those without a card that is left; they
    count in the idf and have no rows.
    """
    entries = deck_cards.where((F.col("board") == board) & (F.col("count") > 0)).join(decks.select("deck_id"), "deck_id", "left_semi")
    entries = entries.groupBy("deck_id", "card_id").agg(F.sum("count").alias("tf"))
    if excluded is not None:
        entries = entries.join(excluded.select("card_id"), "card_id", "left_anti")
    idf = inverse_frequencies(entries, decks.select("deck_id").distinct().count())
    weighted = entries.join(idf, "card_id").select("deck_id", "card_id", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = weighted.groupBy("deck_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, "deck_id").select("deck_id", "card_id", (F.col("raw") / F.col("norm")).alias("weight"))


def tf_idf_slices(deck_cards: DataFrame, decks: DataFrame, excluded: DataFrame | None = None, board: str = "main") -> DataFrame:
    """(slice, deck_id, card_id, weight): ``tf_idf`` of each slice by itself. decks: (slice, deck_id); a deck may be in several.

    Slices may overlap wholly, as windows that grow by a day do, so decks are joined to
    their slices after their copies were summed.
    """
    rows = deck_cards.where((F.col("board") == board) & (F.col("count") > 0)).groupBy("deck_id", "card_id").agg(F.sum("count").alias("tf"))
    if excluded is not None:
        rows = rows.join(excluded.select("card_id"), "card_id", "left_anti")
    members = decks.select("slice", "deck_id").distinct()
    entries = rows.join(members, "deck_id")
    n = members.groupBy("slice").agg(F.count("*").cast("double").alias("n"))
    # A row for each slice and card, and one for each slice.
    having = entries.groupBy("slice", "card_id").agg(F.count("*").alias("having")).join(n, "slice")
    idf = having.select("slice", "card_id", (F.log((1.0 + F.col("n")) / (1.0 + F.col("having"))) + 1.0).alias("idf"))
    weighted = entries.join(idf, ["slice", "card_id"]).select("slice", "deck_id", "card_id", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = weighted.groupBy("slice", "deck_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, ["slice", "deck_id"]).select("slice", "deck_id", "card_id", (F.col("raw") / F.col("norm")).alias("weight"))
