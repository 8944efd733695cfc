from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from deckloom.functions import text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").coalesce(1)


@pytest.mark.parametrize(
    "result, want",
    [
        ("3-1", (None, 3, 1, None)),
        ("3-1-1", (None, 3, 1, 1)),
        ("2nd Place", (2, None, None, None)),
        ("11th Place", (11, None, None, None)),
        ("", (None,) * 4),
        (None, (None,) * 4),
        ("3-1-", (None,) * 4),
        ("2nd place", (None,) * 4),
    ],
)
def test_parse_result(spark, result, want):
    row = column(spark, [result]).select(text.parse_result(F.col("x")).alias("r")).select("r.*").first()
    assert tuple(row) == want


def test_detect_format(spark):
    slugs = ["Modern-league-2020", "legacy-modern-open", "open-2019", "premodern-cup", None]
    found = column(spark, slugs).select(text.detect_format(F.col("x"), {"modern": ["modern"], "legacy": ["legacy"], "none": []})).collect()
    assert [r[0] for r in found] == ["modern", None, None, None, None]


def test_event_type(spark):
    rows = spark.createDataFrame(
        [("mtgo.com", "modern-challenge-32-2023-01-02"), ("mtgo.com_x", "a-b"), ("melee", "a-b-2020-01-01")], "source string, slug string"
    ).coalesce(1)
    assert [r[0] for r in rows.select(text.event_type(F.col("source"), F.col("slug"))).collect()] == ["challenge-32", None, "tournament"]


@pytest.mark.parametrize(
    "written, want",
    [
        ("2024-01-05T23:59:00-08:00", date(2024, 1, 5)),
        ("2024-01-05T00:00:00Z", date(2024, 1, 5)),
        ("2024-01-05", date(2024, 1, 5)),
        ("2024-02-30T00:00:00Z", date(2020, 1, 2)),
        ("2024-01-05 and more", date(2020, 1, 2)),
        ("", date(2020, 1, 2)),
        (None, date(2020, 1, 2)),
    ],
)
def test_event_date(spark, written, want):
    assert column(spark, [written]).select(text.event_date(F.col("x"), F.lit("2020/01/02"))).first()[0] == want


def test_fold(spark):
    names = ["Æther Vial", " Lim-Dûl ", "Straße", None, "ﬁne"]
    found = column(spark, names).select(text.fold_name("x")).collect()
    assert [r[0] for r in found] == ["æther vial", "lim-dul", "strasse", None, "fine"]


@pytest.mark.parametrize(
    "name, with_color, color, want",
    [
        ("GenericControl", True, "U", "Mono Blue Control"),
        ("GenericControl", True, "C", "Control"),
        ("UWControl", False, "WU", "UW Control"),
        ("Eldrazi4Color", True, "WUBRG", "5 Color Eldrazi 4 Color"),
        ("Tron", True, "RG", "Gruul Tron"),
    ],
)
def test_display_label(spark, name, with_color, color, want):
    row = column(spark, [name]).select(text.display_label(F.col("x"), F.lit(with_color), F.lit(color))).first()
    assert row[0] == want


def test_ratio(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double").coalesce(1)
    assert [r[0] for r in rows.select(text.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
