"""The evaluation as a whole: clusters against rules over a window, new kinds of decks with their rule hidden, a report.

Everything is made twice and compared digit by digit, so that a result that depends on
chance or order is seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.definitions import Definitions
from . import clusters, evaluate, quality, rules, vectors
from .importer import load_window
from .numbering import cut

#: Fixed value: days of an emergence window, its first included and one more.
WINDOW_DAYS = 60


@dataclass(frozen=True)
class Release:
    """A new kind of deck: the rule file that is hidden, the card that tells its decks, the day it may first appear."""

    name: str
    rule_file: str
    key_card: str
    start: date


@dataclass(frozen=True)
class Holdout:
    decks: int
    labelled: int
    conflicts: int
    fallback: int
    clusters: int
    noise: int
    agreement: float
    rand_index: float
    per_label: tuple[tuple[str, int, float, float, float], ...]
    version: str = ""

    @property
    def worst_f1(self) -> float | None:
        return min((f1 for *_, f1 in self.per_label), default=None)


@dataclass(frozen=True)
class Evaluation:
    holdout: Holdout
    releases: tuple[tuple[Release, evaluate.Emergence], ...] = ()
    verdict: dict[str, bool] = field(default_factory=dict)


def clustered_slices(cards: DataFrame, slices: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """(slice, deck_id, cluster) of decks by their own slice's TF-IDF, noise attached where it is near."""
    return cut(clusters.cluster_and_attach(vectors.tf_idf_slices(cards, slices, excluded), slices))


def holdout(cards: DataFrame, decks: DataFrame, defs: Definitions, excluded: DataFrame | None = None, established: int = evaluate.ESTABLISHED) -> Holdout:
    """Clusters of all decks of a window against the labels that rules give.

    cards: deck_id, card_id, count, board; decks: deck_id.
    Only counts, and one row for each established label, reach the driver.
    """
    classified = cut(rules.classify(cards, rules.compile_rules(cards.sparkSession, defs)))
    slices = decks.select(F.lit("holdout").alias("slice"), "deck_id").distinct()
    found = clustered_slices(cards, slices, excluded).select("deck_id", "cluster")
    truth = evaluate.ground_truth(classified)
    predicted = cut(evaluate.predictions(found, truth))
    said = classified.agg(F.count_if(F.size("conflict") > 0), F.count_if(F.col("method") == "fallback")).first()
    made = found.agg(F.count("*"), F.count_distinct(F.nullif("cluster", F.lit(clusters.NOISE))), F.count_if(F.col("cluster") == clusters.NOISE)).first()
    labels = evaluate.per_label(predicted, established).orderBy("label").collect()
    return Holdout(
        decks=made[0], labelled=truth.count(), conflicts=said[0], fallback=said[1], clusters=made[1], noise=made[2],
        agreement=evaluate.agreement(predicted, established).first()["agreement"],
        rand_index=evaluate.adjusted_rand(predicted, "truth", "cluster").first()["ari"],
        per_label=tuple((r["label"], r["n"], r["precision"], r["recall"], r["f1"]) for r in labels), version=defs.version,
    )


def blind(cards: DataFrame, decks: DataFrame, key_card: int, defs: Definitions, excluded: DataFrame | None = None) -> evaluate.Emergence:
    """Whether clusters show the decks with a card in the main zone, of which no rule in ``defs`` knows. decks: deck_id, date."""
    with_card = cards.where((F.col("card_id") == key_card) & (F.col("board") == "main") & (F.col("count") > 0)).select("deck_id").distinct()
    classified = rules.classify(cards, rules.compile_rules(cards.sparkSession, defs))
    left = cut(evaluate.remainder(decks, classified))
    return evaluate.emergence(left, decks.join(with_card, "deck_id", "left_semi"), lambda slices: clustered_slices(cards, slices, excluded))


def card_named(tables: dict[str, DataFrame], game: str, name: str) -> int:
    """The id of a game's card of this very name."""
    own = tables["cards"].join(tables["games"].where(F.col("name") == game).select(F.col("id").alias("game_id")), "game_id", "left_semi")
    found = own.where(F.col("name") == name).agg(F.min("id")).first()[0]
    if found is None:
        raise ValueError(f"{game} has no card named {name!r}")
    return found


def excluded_cards(tables: dict[str, DataFrame], format_name: str) -> DataFrame:
    """Cards that the format's settings keep out of vectors."""
    chosen = tables["formats"].where(F.col("name") == format_name).select("config.vector_exclude_type_line_prefixes").first()
    return vectors.excluded_cards(tables["cards"], list((chosen and chosen[0]) or []))


def window(tables: dict[str, DataFrame], first, last, format_name: str, game: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cards (deck_id, card_id, count, board) and decks (deck_id, date) between two days, both included; decks without a card are left out."""
    rows = cut(load_window(tables, first, last, format_name, game))
    return rows.drop("date"), rows.select("deck_id", "date").distinct()


def evaluation(
    tables: dict[str, DataFrame],
    load: Callable[[frozenset[str]], Definitions],
    format_name: str,
    game: str,
    start: date,
    end: date,
    releases: tuple[Release, ...] = (),
    established: int = evaluate.ESTABLISHED,
) -> Evaluation:
    """A window against the rules, and each release without its own.

    ``load`` gives the definitions less some rule files. Hiding a file has to take just
    one rule away, or ValueError is raised.
    """
    full, excluded = load(frozenset()), excluded_cards(tables, format_name)

    cards, decks = window(tables, start, end, format_name, game)
    against = holdout(cards, decks, full, excluded, established)
    seen = []
    for release in releases:
        less = load(frozenset({release.rule_file}))
        if len(less.rules) != len(full.rules) - 1:
            raise ValueError(f"hiding {release.rule_file!r} takes {len(full.rules) - len(less.rules)} rules away")
        cards, decks = window(tables, release.start, F.date_add(F.lit(release.start), WINDOW_DAYS), format_name, game)
        seen.append((release, blind(cards, decks, card_named(tables, game, release.key_card), less, excluded)))
    return Evaluation(against, tuple(seen), evaluate.verdict(against.agreement, against.worst_f1, [e for _, e in seen]))


def digits(found: Evaluation) -> str:
    """The evaluation as text, numbers with fixed digits: shares with six, purities with four.

    Python's formatting rounds the number as it is stored, halves to even; built-in
    rounding of columns would differ in the last digit.
    """
    h = asdict(found.holdout)
    h["per_label"] = [[name, n, *(f"{x:.6f}" for x in rest)] for name, n, *rest in h["per_label"]]
    h |= {k: f"{h[k]:.6f}" for k in ("agreement", "rand_index")}
    seen = [asdict(r) | asdict(e) | {"purity": f"{e.purity:.4f}", "passed": e.passed} for r, e in found.releases]
    return json.dumps({"holdout": h, "releases": seen, "verdict": found.verdict}, sort_keys=True, default=str, indent=1)


def twice(make: Callable[[], Evaluation]) -> tuple[Evaluation, bool]:
    """The evaluation, and whether making it again gives the same digits."""
    found = make()
    return found, digits(found) == digits(make())


def report(found: Evaluation, same: bool, day: str) -> str:
    """A Markdown report."""
    h = found.holdout
    word = lambda ok: "pass" if ok else "fail"
    worst = "-" if h.worst_f1 is None else f"{h.worst_f1:.4f}"
    parts = [
        f"# Clusters against rules, {day}\n\nRules: {h.version}\n",
        quality.markdown_table(
            ["measure", "value", "target", "result"],
            [
                ["agreement", f"{h.agreement:.4f}", f">= {evaluate.AGREEMENT}", word(found.verdict["agreement"])],
                ["least F1", worst, f">= {evaluate.LEAST_F1}", word(found.verdict["f1"])],
                ["new kinds found", f"{sum(e.passed for _, e in found.releases)} of {len(found.releases)}", "all", word(found.verdict["emergence"])],
                ["made twice", "equal" if same else "different", "equal", word(same)],
            ],
        ),
        "## Window\n",
        quality.markdown_table(
            ["decks", "by rules", "conflicts", "by fallback", "clusters", "noise", "Rand index"],
            [[h.decks, h.labelled, h.conflicts, h.fallback, h.clusters, h.noise, f"{h.rand_index:.4f}"]],
        ),
        "## Labels\n",
        quality.markdown_table(["label", "decks", "precision", "recall", "F1"], [[n, k, *(f"{x:.4f}" for x in rest)] for n, k, *rest in h.per_label]),
        "## New kinds\n",
        quality.markdown_table(
            ["release", "key card", "decks", "enough on", "until", "found on", "cluster", "purity"],
            [
                [r.name, r.key_card, e.target_decks, e.first or "-", e.deadline or "-", e.detected_on or "-", e.size, f"{e.purity:.4f}"]
                for r, e in found.releases
            ],
        ),
    ]
    return "\n".join(parts)
