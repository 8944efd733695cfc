"""Command line: ``python -m deckloom.cli cards|events|report|classify|evaluate``."""

from __future__ import annotations

import argparse
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, holdout, importer, labels, quality, resolve, rules
from .schemas import TABLES
from .sources.cards import card_table, read_cards
from .sources.definitions import Audit, load_definitions, load_formats
from .sources.tables import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="deckloom")
    p.add_argument("--store", required=True, help="folder of the canonical tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cards", help="load a card catalogue")
    c.add_argument("--file", required=True)
    e = sub.add_parser("events", help="import event documents")
    e.add_argument("--root", required=True)
    e.add_argument("--formats", required=True, help="settings file")
    e.add_argument("--game", required=True)
    e.add_argument("--format", action="append", help="import these formats only")
    r = sub.add_parser("report", help="write the quality report")
    r.add_argument("--out", required=True)
    r.add_argument("--date", default=date.today().isoformat())
    k = sub.add_parser("classify", help="label a format's decks")
    k.add_argument("--definitions", required=True)
    k.add_argument("--format", required=True)
    k.add_argument("--game", help="of the format; needed if several games have one of its name")
    k.add_argument("--out", help="a folder for all columns of the classified decks, too")
    v = sub.add_parser("evaluate", help="compare clusters with rules, twice; exit code 2 if the results differ")
    v.add_argument("--definitions", required=True)
    v.add_argument("--format", required=True)
    v.add_argument("--game", required=True)
    v.add_argument("--start", required=True, type=date.fromisoformat)
    v.add_argument("--end", required=True, type=date.fromisoformat)
    v.add_argument("--release", action="append", default=[], type=release, help="name|rule file without .json|key card|first day")
    v.add_argument("--established", type=int, default=evaluate.ESTABLISHED, help="decks that make a label count")
    v.add_argument("--out", required=True)
    v.add_argument("--date", default=date.today().isoformat())
    return p


def release(text: str) -> holdout.Release:
    name, rule_file, key_card, day = text.split("|")
    return holdout.Release(name, rule_file, key_card, date.fromisoformat(day))


def evaluated(store: Store, args: argparse.Namespace) -> int:
    known = resolver(store)(rule_names(args.definitions, args.format))
    tables = {n: store.read(n) for n in TABLES}

    def make() -> holdout.Evaluation:
        return holdout.evaluation(
            tables, lambda hidden: load_definitions(args.definitions, args.format, known.get, without=hidden), args.format, args.game,
            args.start, args.end, tuple(args.release), args.established,
        )

    found, same = holdout.twice(make)
    Path(args.out).write_text(holdout.report(found, same, args.date))
    print(holdout.digits(found))
    return 0 if same else 2


def resolver(store: Store):
    """name to card id for rule files, whose names are few beside the catalogue's."""
    index = resolve.name_index(store.read("cards")).select("name", "card_id")

    def lookup(names: list[str]) -> dict[str, int]:
        spark = store.spark
        asked = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
        found = resolve.resolve_names(asked, store.read("cards")) if names else asked.join(index, "name")
        return {r["name"]: r["card_id"] for r in found.where("card_id is not null").collect()}

    return lookup


def rule_names(root: str, format_name: str) -> list[str]:
    """All names that rule files of a format may hold."""
    names: list[str] = []
    audit = Audit()
    load_definitions(root, format_name, lambda n: names.append(n), audit=audit)
    return names


def format_of(store: Store, name: str, game: str | None) -> int:
    """The id of a format. Raises ValueError if there is none, or more than one."""
    found = store.read("formats").where(F.col("name") == name)
    if game is not None:
        found = found.join(store.read("games").where(F.col("name") == game).select(F.col("id").alias("game_id")), "game_id", "left_semi")
    ids = [r["id"] for r in found.select("id").collect()]
    if len(ids) != 1:
        raise ValueError(f"{len(ids)} formats are called {name}")
    return ids[0]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("deckloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "cards":
        store.load_cards(card_table(read_cards(spark, args.file)))
    elif args.command == "events":
        print(importer.run_import(store, args.root, load_formats(args.formats), args.game, set(args.format) if args.format else None).summary())
    elif args.command == "report":
        Path(args.out).write_text(quality.report({n: store.read(n) for n in TABLES}, args.date))
    elif args.command == "evaluate":
        return evaluated(store, args)
    else:
        known = resolver(store)(rule_names(args.definitions, args.format))
        defs = load_definitions(args.definitions, args.format, known.get)
        format_id = format_of(store, args.format, args.game)
        own = store.read("events").where(F.col("format_id") == format_id).select(F.col("id").alias("event_id"))
        decks = store.read("decks").join(own, "event_id", "left_semi").select(F.col("id").alias("deck_id"))
        found = rules.classify(store.read("deck_cards").join(decks, "deck_id", "left_semi"), rules.compile_rules(spark, defs))
        if args.out:
            found.withColumn("classifier_version", F.lit(defs.version)).write.parquet(args.out)
        counts = labels.store_labels(store, found, format_id, defs.version)
        stored = labels.current_labels(store.read("archetype_labels"), store.read("archetypes"), defs.version)
        print(f"{defs.version} {counts} {evaluate.digest(stored.groupBy('label').count())}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
