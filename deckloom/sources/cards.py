"""Card catalogues: JSON lines or one JSON array, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..schemas import CARD_DOCUMENT, struct

#: Layouts that are no playable cards, and set types whose cards give way to others of their name.
NOT_PLAYABLE = ("token", "double_faced_token", "emblem", "art_series", "vanguard", "scheme", "planar")
SECOND_TIER = ("funny", "memorabilia")


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character of the file that is no blank opens an array."""
    head = spark.read.option("wholetext", False).text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return head is not None and head[0] == "["


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(struct(CARD_DOCUMENT)).option("mode", "FAILFAST")
    return reader.option("multiLine", is_array(spark, path)).json(path)


def card_table(raw: DataFrame, game_id: int = 1) -> DataFrame:
    """The ``cards`` table: playable ones, numbered by tier and reference.

    Raises ValueError if a reference occurs twice among them.
    """
    playable = raw.where(~F.coalesce(F.col("layout"), F.lit("")).isin(*NOT_PLAYABLE))
    twice = playable.groupBy("oracle_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"references that occur twice: {sorted(r[0] for r in twice)}")
    tier = F.coalesce(F.col("set_type").isin(*SECOND_TIER), F.lit(False)).cast("int")
    faces = F.when(F.size("card_faces") > 0, F.transform("card_faces", lambda f: f["name"]))
    attrs = F.struct("layout", "set_type", "type_line", tier.alias("resolution_tier"), faces.alias("face_names"))
    rows = playable.select(F.lit(game_id).alias("game_id"), F.col("oracle_id").alias("canonical_ref"), "name", attrs.alias("attrs"), tier.alias("_tier"))
    return numbered(rows, ["_tier", "canonical_ref"]).select("id", "game_id", "canonical_ref", "name", "attrs")


def left_out(raw: DataFrame) -> DataFrame:
    """How many objects of each unplayable layout a catalogue has."""
    return raw.where(F.col("layout").isin(*NOT_PLAYABLE)).groupBy("layout").agg(F.count("*").alias("n"))
