"""Data-quality queries over the canonical tables, gates after an import, and the report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS

Tables = Mapping[str, DataFrame]
BUCKETS = ["0", "1-59", "60", "61-69", "70-79", "80-89", "90+"]


def row_counts(tables: Tables) -> DataFrame:
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, one)


def _with_decks(events: DataFrame, decks: DataFrame, *columns: Column) -> DataFrame:
    """Events with their number of decks: decks are counted before the join, so only counts are shuffled."""
    per_event = decks.groupBy("event_id").agg(F.count("id").alias("decks"))
    return events.select("id", *columns).join(per_event, events["id"] == per_event["event_id"], "left")


def by_year_and_source(events: DataFrame, decks: DataFrame) -> DataFrame:
    rows = _with_decks(events, decks, F.year("date").alias("year"), F.col("source"))
    return rows.groupBy("year", "source").agg(F.count("id").alias("events"), F.coalesce(F.sum("decks"), F.lit(0)).alias("decks"))


def by_event_type(events: DataFrame, decks: DataFrame) -> DataFrame:
    rows = _with_decks(events, decks, F.coalesce("event_type", F.lit("(null)")).alias("event_type"))
    return rows.groupBy("event_type").agg(F.count("id").alias("events"), F.coalesce(F.sum("decks"), F.lit(0)).alias("decks"))


def unresolved_totals(unresolved: DataFrame) -> DataFrame:
    return unresolved.agg(
        F.count("*").alias("names"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum("decks_affected"), F.lit(0)).alias("decks_affected"),
    )


def top_unresolved(unresolved: DataFrame, k: int = 50) -> DataFrame:
    return unresolved.select("card_name", "occurrences", "decks_affected").orderBy(F.desc("occurrences"), "card_name").limit(k)


def _orphans(name: str, child: DataFrame, key: str, parent: DataFrame, of: list[str] | None = None) -> DataFrame:
    """Rows of a child table whose key is missing or has no parent. Child keys are counted before the join.

    of: the child has lines, and those equal in these columns are one row. Summing all of them would hold nearly every line in
    memory, so those with a parent go first, in a join that holds the parents' keys only.
    """
    if of is not None:
        lost = child.select(*of).join(parent.select(F.col("id").alias(key)).hint("shuffle_hash"), key, "left_anti").distinct()
        return lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    keys = child.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col("id").alias("k")), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("check_name"), "n")


def orphans(tables: Tables, lines: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(check_name, n) of each reference. lines: tables that have lines, and the columns in which those of one row are equal."""
    lines = lines or {}
    pairs = [
        ("decks -> events", "decks", "event_id", "events"),
        ("deck_cards -> decks", "deck_cards", "deck_id", "decks"),
        ("deck_cards -> cards", "deck_cards", "card_id", "cards"),
        ("events -> formats", "events", "format_id", "formats"),
        ("events -> games", "events", "game_id", "games"),
    ]
    return reduce(DataFrame.unionByName, [_orphans(n, tables[c], k, tables[p], lines.get(c)) for n, c, k, p in pairs])


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicates(events: DataFrame) -> DataFrame:
    n = duplicate_keys(events, KEYS["events"]).agg(F.count("*").alias("n"))
    return n.select(F.lit("duplicate (source, source_event_id)").alias("check_name"), "n")


def violations(tables: Tables, today: Column | None = None) -> DataFrame:
    """Events after ``today`` (a date column; now if none is given), and card counts below one."""
    today = F.current_date() if today is None else today
    future = tables["events"].agg(F.count_if(F.col("date") > today).alias("n"))
    low = tables["deck_cards"].agg(F.count_if(F.col("count") < 1).alias("n"))
    return future.select(F.lit("events dated in the future").alias("check_name"), "n").unionByName(
        low.select(F.lit("deck_cards with count < 1").alias("check_name"), "n")
    )


def integrity(tables: Tables, today: Column | None = None) -> DataFrame:
    """All checks: (check_name, n)."""
    return orphans(tables).unionByName(duplicates(tables["events"])).unionByName(violations(tables, today))


def deck_sizes(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """(id, event_id, main, side) of every deck, also those without a card. Cards are summed before the join."""
    sums = deck_cards.groupBy("deck_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("board") == b, F.col("count"))), F.lit(0)).alias(b) for b in ("main", "side")]
    )
    return decks.select("id", "event_id").join(sums, decks["id"] == sums["deck_id"], "left").select(
        "id", "event_id", *[F.coalesce(b, F.lit(0)).alias(b) for b in ("main", "side")]
    )


def size_bucket(main: Column) -> Column:
    return (
        F.when(main == 0, "0").when(main < 60, "1-59").when(main == 60, "60").when(main <= 69, "61-69")
        .when(main <= 79, "70-79").when(main <= 89, "80-89").otherwise("90+")
    )


def size_histogram(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """(bucket, decks) by the size of the main zone, smallest first."""
    sizes = deck_sizes(decks, deck_cards)
    per = sizes.groupBy(size_bucket(F.col("main")).alias("bucket")).agg(F.count("*").alias("decks"), F.min("main").alias("_least"))
    return per.orderBy("_least").drop("_least")


def size_anomalies(
    events: DataFrame, decks: DataFrame, deck_cards: DataFrame, formats: DataFrame, least_main: int = 60, most_side: int = 15
) -> DataFrame:
    """Per format: decks, those without a main zone, with one that is too small, with a side zone that is too large."""
    placed = deck_sizes(decks, deck_cards).join(events.select(F.col("id").alias("event_id"), "format_id"), "event_id")
    per = placed.groupBy("format_id").agg(
        F.count("*").alias("decks"),
        F.count_if(F.col("main") == 0).alias("empty_main"),
        F.count_if((F.col("main") > 0) & (F.col("main") < least_main)).alias("undersized_main"),
        F.count_if(F.col("side") > most_side).alias("oversized_side"),
    )
    named = per.join(formats.select(F.col("id").alias("format_id"), F.col("name").alias("format")), "format_id")
    counts = ["decks", "empty_main", "undersized_main", "oversized_side"]
    return named.groupBy("format").agg(*[F.sum(c).alias(c) for c in counts])


def record_coverage(events: DataFrame, decks: DataFrame) -> DataFrame:
    """Per source and event type: decks, and those with a record."""
    per_event = decks.groupBy("event_id").agg(F.count_if(F.col("wins").isNotNull()).alias("r"), F.count("*").alias("d"))
    rows = per_event.join(events.select(F.col("id").alias("event_id"), "source", "event_type"), "event_id")
    return rows.groupBy("source", "event_type").agg(F.sum("r").alias("decks_with_record"), F.sum("d").alias("decks"))


def gate_problems(tables: Tables, today: Column | None = None) -> list[str]:
    """What an import left that must not be: empty tables, and checks with their violations."""
    problems = [f"no {t}" for t in ("events", "decks") if tables[t].isEmpty()]
    wanted = ("events dated in the future", "decks -> events", "deck_cards with count < 1")
    return problems + [f"{r.check_name}: {r.n}" for r in integrity(tables, today).collect() if r.n and r.check_name in wanted]


def gates(tables: Tables, today: Column | None = None) -> None:
    """Raises ValueError, listing every problem, if an import left something that must not be."""
    problems = gate_problems(tables, today)
    if problems:
        raise ValueError("; ".join(problems))


def markdown_table(headers: list[str], rows: list) -> str:
    lines = ["| " + " | ".join(headers) + " |", "|" + "|".join(["---"] * len(headers)) + "|"]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows])


def report(tables: Tables, title_date: str, today: Column | None = None) -> str:
    """The quality report as Markdown. Collects aggregates only."""
    e, d, dc, f, u = (tables[t] for t in ("events", "decks", "deck_cards", "formats", "ingest_unresolved_cards"))
    checks = integrity(tables, today).collect()
    parts = [
        ("Row counts", ["table", "rows"], row_counts(tables).orderBy("table_name").collect()),
        ("Events and decks by year and source", ["year", "source", "events", "decks"], by_year_and_source(e, d).orderBy("year", "source").collect()),
        ("Events and decks by type", ["event_type", "events", "decks"], by_event_type(e, d).orderBy(F.desc("events"), "event_type").collect()),
        ("Unresolved names", ["names", "occurrences", "decks affected"], unresolved_totals(u).collect()),
        ("Top unresolved names", ["name", "occurrences", "decks affected"], top_unresolved(u).collect()),
        ("Integrity", ["check", "violations"], checks),
        ("Main zone sizes", ["size", "decks"], size_histogram(d, dc).collect()),
        ("Anomalies by format", ["format", "decks", "empty main", "small main", "large side"], size_anomalies(e, d, dc, f).orderBy("format").collect()),
        ("Record coverage", ["source", "event_type", "with record", "decks"], record_coverage(e, d).orderBy("source", F.col("event_type").asc_nulls_last()).collect()),
    ]
    text = [f"# Data quality, {title_date}"]
    for title, headers, rows in parts:
        text += [f"## {title}", markdown_table(headers, rows)]
    text.append(f"All checks pass: **{all(r.n == 0 for r in checks)}**")
    return "\n\n".join(text) + "\n"
