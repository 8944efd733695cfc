"""Canonical tables and raw documents: their types, written out, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMAT_CONFIG = (
    "struct<slug_tokens:array<string>,board_zones:array<string>,expected_mainboard_min:int,"
    "expected_sideboard_max:int,vector_exclude_type_line_prefixes:array<string>>"
)
CARD_ATTRS = "struct<layout:string,set_type:string,type_line:string,resolution_tier:int,face_names:array<string>>"

TABLES: dict[str, str] = {
    "games": "id int, name string",
    "formats": f"id int, game_id int, name string, config {FORMAT_CONFIG}",
    "cards": f"id bigint, game_id int, canonical_ref string, name string, attrs {CARD_ATTRS}",
    "events": "id bigint, game_id int, source string, source_event_id string, format_id int, name string, "
    "date date, event_type string, player_count int, raw_ref string",
    "archetypes": "id int, format_id int, name string, status string, parent_id int, created_at timestamp",
    "decks": "id bigint, event_id bigint, player string, finish_rank int, wins int, losses int, draws int, "
    "archetype_id int, classifier_version string",
    "deck_cards": "deck_id bigint, card_id bigint, count int, board string",
    "matches": "id bigint, event_id bigint, round string, deck_id_a bigint, deck_id_b bigint, result string",
    "archetype_labels": "deck_id bigint, archetype_id int, classifier_version string, method string, confidence double",
    "ingest_unresolved_cards": "id bigint, game_id int, format_id int, card_name string, occurrences int, decks_affected int",
}

#: Columns that identify a row; Spark does not enforce them, ``quality.duplicate_keys`` counts violations.
KEYS: dict[str, list[str]] = {
    "games": ["name"],
    "formats": ["game_id", "name"],
    "cards": ["game_id", "canonical_ref"],
    "events": ["source", "source_event_id"],
    "archetypes": ["format_id", "name"],
    "decks": ["id"],
    "deck_cards": ["deck_id", "card_id", "board"],
    "matches": ["id"],
    "archetype_labels": ["deck_id", "classifier_version"],
    "ingest_unresolved_cards": ["game_id", "format_id", "card_name"],
}

_CARD_LINES = "array<struct<CardName:string,Count:int>>"
#: A raw event document. Standings stay variants, since an absent field and a null one differ.
EVENT_DOCUMENT = (
    "Tournament struct<Date:string,Name:string,Uri:string>, "
    f"Decks array<struct<Date:string,Player:string,Result:string,AnchorUri:string,Mainboard:{_CARD_LINES},Sideboard:{_CARD_LINES}>>, "
    "Rounds array<struct<RoundName:string,Matches:array<struct<Player1:string,Player2:string,Result:string>>>>, "
    "Standings array<variant>"
)
CARD_DOCUMENT = (
    "oracle_id string, name string, layout string, set_type string, type_line string, card_faces array<struct<name:string>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A canonical table without rows."""
    return spark.createDataFrame([], TABLES[name])
