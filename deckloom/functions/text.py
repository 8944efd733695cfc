"""Scalar functions over names, slugs, results and dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sources whose file names carry the event type, and the type of all others.
SLUG_SOURCE_PREFIX, OTHER_EVENT_TYPE = "mtgo.com", "tournament"

#: Colour letters in order, and what a combination puts before a name.
COLORS = "WUBRG"
COLOR_NAMES = {
    "W": "MonoWhite", "U": "MonoBlue", "B": "MonoBlack", "R": "MonoRed", "G": "MonoGreen",
    "WU": "Azorius", "WB": "Orzhov", "WR": "Boros", "WG": "Selesnya",
    "UB": "Dimir", "UR": "Izzet", "UG": "Simic",
    "BR": "Rakdos", "BG": "Golgari", "RG": "Gruul",
    "WUB": "Esper", "WUR": "Jeskai", "WUG": "Bant",
    "WBR": "Mardu", "WBG": "Abzan", "WRG": "Naya",
    "UBR": "Grixis", "UBG": "Sultai", "URG": "Temur",
    "BRG": "Jund",
    "WUBR": "WUBR", "WBRG": "WBRG", "WUBG": "WUBG", "WURG": "WURG", "UBRG": "UBRG",
    "WUBRG": "5Color",
}
#: Fixed value: where words of a name in Pascal case part.
WORD_START = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z])"

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"


def detect_format(slug: Column, tokens: dict[str, list[str]]) -> Column:
    """The one format that has a token among the slug's hyphen-separated parts; null for none or several."""
    parts = F.split(F.lower(slug), "-")
    hits = [F.when(F.arrays_overlap(parts, F.array(*[F.lit(t) for t in words])), F.lit(name)) for name, words in sorted(tokens.items()) if words]
    if not hits:
        return F.lit(None).cast("string")
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def event_type(source: Column, slug: Column) -> Column:
    """What stands between the first part and the date of a slug; another source's events are of one type."""
    part = F.nullif(F.regexp_extract(F.lower(slug), r"^[a-z0-9]+-(.+?)-\d{4}-\d{2}-\d{2}", 1), F.lit(""))
    return F.when(source.startswith(SLUG_SOURCE_PREFIX), part).otherwise(F.lit(OTHER_EVENT_TYPE))


def parse_result(result: Column) -> Column:
    """struct(finish_rank, wins, losses, draws) of ``3-1``, ``3-1-1`` or ``2nd Place``; nulls for anything else."""
    record, place = r"^(\d+)-(\d+)(?:-(\d+))?$", r"^(\d+)(?:st|nd|rd|th) Place$"

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(result, pattern, group), F.lit("")).try_cast("int")

    return F.struct(
        number(place, 1).alias("finish_rank"),
        number(record, 1).alias("wins"),
        number(record, 2).alias("losses"),
        number(record, 3).alias("draws"),
    )


def event_date(written: Column, path_date: Column) -> Column:
    """The calendar day as written, whatever its offset; that of the path (yyyy/MM/dd) if there is no valid one."""
    day = F.when(written.rlike(_ISO), F.try_to_date(F.substring(written, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(day, F.try_to_date(path_date, "yyyy/MM/dd"))


def fold(name: str) -> str:
    """A name without accents and case, for comparing."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return plain.casefold().strip()


@F.pandas_udf(T.StringType())
def fold_name(names: pd.Series) -> pd.Series:
    """``fold`` in batches. Meant for distinct names, not for every row that holds one."""
    return names.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(names: pd.Series) -> pd.Series:
    return names.map(str.casefold, na_action="ignore")


def color_prefix(color: Column) -> Column:
    pairs = [F.lit(x) for kv in COLOR_NAMES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), color), F.lit(""))


def display_label(name: Column, with_color: Column, color: Column) -> Column:
    """A rule's name for people: no ``Generic``, the colours before it if asked for, words apart."""
    bare = F.replace(name, F.lit("Generic"), F.lit(""))
    full = F.when(with_color, F.concat(color_prefix(color), bare)).otherwise(bare)
    return F.trim(F.regexp_replace(F.regexp_replace(full, WORD_START, " "), r"\s+", " "))


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | col.startswith(p)
    return found


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
