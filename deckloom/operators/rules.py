"""Classifies decks by rules: conditions over card sets, variants, conflicts, fallbacks, colours and labels.

Definitions are compiled on the driver into small tables. Their size is that of the
rule files (hundreds of rows), so they are broadcast. What a card means to conditions,
fallbacks and colours is one row of the table ``facts``, which has one for each card of
a colour too: it is broadcast up to ``FACTS`` rows. So the deck cards are read
once and shuffled once, by deck, and all that follows keeps that partitioning. Copies
of a card do not matter to conditions, its presence in a zone does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import COLORS, display_label
from ..sources.definitions import CONDITIONS, Definitions, Rule

#: Fixed value: a fallback has to be more similar than this.
LEAST_SIMILARITY = 0.1
#: Cards with facts up to which they are broadcast.
FACTS = 200_000


@dataclass
class Compiled:
    """rules: rule_id, parent_id, file_order, variant_order, name, parent_name, with_color, n_conditions, n_needed.

    conditions: cond_id, rule_id, need, forbids. fallbacks: fallback_id, n_cards, name, with_color.
    facts: card_id, facts (array of kind, id, main, side): ``condition`` with how much the card counts in a
    zone, ``fallback``, and ``land`` or ``nonland`` with the number of a colour letter.
    always: rules (as rows of ``rules``) that need no card, which hold unless a condition forbids them.
    """

    rules: DataFrame
    conditions: DataFrame
    fallbacks: DataFrame
    facts: DataFrame
    always: list[tuple]


RULE = (
    "rule_id int, parent_id int, file_order int, variant_order int, name string, parent_name string, "
    "with_color boolean, n_conditions int, n_needed int"
)
MATCH = ["file_order", "variant_order", "rule_id", "parent_id", "name", "parent_name", "with_color", "n_conditions"]


def compile_rules(spark: SparkSession, defs: Definitions) -> Compiled:
    rules: list[tuple] = []
    conditions: list[tuple] = []
    facts: dict[int, list[tuple]] = {}

    def add(rule: Rule, parent: int | None, parent_name: str, file_order: int, variant_order: int, inherited: int) -> None:
        rule_id, needed, impossible = len(rules), 0, False
        rules.append(())
        for c in rule.conditions:
            use_main, use_side, need, forbids = CONDITIONS[c.kind]
            cond_id = len(conditions)
            conditions.append((cond_id, rule_id, need, forbids))
            if c.listed == 0:
                continue
            if not forbids:
                needed += 1
                impossible = impossible or len(c.cards) * (use_main + use_side) < need
            for card in c.cards:
                facts.setdefault(card, []).append(("condition", cond_id, int(use_main), int(use_side)))
        total = inherited + len(rule.conditions)
        rules[rule_id] = (rule_id, parent, file_order, variant_order, rule.name, parent_name, rule.with_color, total, -1 if impossible else needed)
        for k, v in enumerate(rule.variants):
            add(v, rule_id, rule.name, file_order, k + 1, total)

    for k, rule in enumerate(defs.rules):
        add(rule, None, rule.name, k, 0, 0)
    for k, f in enumerate(defs.fallbacks):
        for card in set(f.cards):
            facts.setdefault(card, []).append(("fallback", k, 0, 0))
    for kind, table in (("land", defs.land_colors), ("nonland", defs.nonland_colors)):
        for card, letters in table.items():
            for letter in letters:
                facts.setdefault(card, []).append((kind, COLORS.index(letter), 0, 0))
    frame = spark.createDataFrame
    known = frame(sorted(facts.items()), "card_id long, facts array<struct<kind:string,id:int,main:int,side:int>>")
    return Compiled(
        frame(rules, RULE),
        frame(conditions, "cond_id int, rule_id int, need int, forbids boolean"),
        frame([(k, len(f.cards), f.name, f.with_color) for k, f in enumerate(defs.fallbacks)], "fallback_id int, n_cards int, name string, with_color boolean"),
        F.broadcast(known) if len(facts) <= FACTS else known,
        [r for r in rules if r[8] == 0],
    )


def tallies(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, kind, id, n), partitioned by deck: how often a deck meets each condition, fallback and colour.

    Kind ``entry`` counts its cards. A card that a condition lists twice counts twice;
    so does one in both zones. A board other than main counts as side.
    """
    entries = deck_cards.where("count > 0").select("deck_id", "card_id", "count", (F.col("board") == "main").alias("in_main"))
    zone = lambda f: F.when(F.col("in_main"), f["main"]).otherwise(f["side"]).cast("long")
    met = F.transform(
        "facts",
        lambda f: F.struct(f["kind"].alias("kind"), f["id"].alias("id"), F.when(f["kind"] == "condition", zone(f)).otherwise(F.col("count").cast("long")).alias("n")),
    )
    kinds = "array<struct<kind:string,id:int,n:bigint>>"
    itself = F.array(F.struct(F.lit("entry").alias("kind"), F.lit(0).alias("id"), F.lit(1).cast("long").alias("n"))).cast(kinds)
    rows = entries.join(compiled.facts, "card_id", "left").select(
        "deck_id", F.explode(F.concat(itself, F.coalesce(met.cast(kinds), F.array().cast(kinds)))).alias("x")
    )
    return rows.repartition("deck_id").groupBy("deck_id", "x.kind", "x.id").agg(F.sum("x.n").alias("n"))


def condition_hits(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, rule_id, cond_id, forbids, hit) for conditions of which the deck has a listed card."""
    rows = tallies(deck_cards, compiled).where("kind = 'condition'").withColumnRenamed("id", "cond_id")
    return rows.join(F.broadcast(compiled.conditions), "cond_id").select(
        "deck_id", "rule_id", "cond_id", "forbids", (F.col("n") >= F.col("need")).alias("hit")
    )


def profiles(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, matches, entries, fallback, color) of every deck with a card.

    matches: rules whose conditions all hold, taken by themselves, in file order;
    fallback: (minus_weight, n_cards, fallback_id, name, with_color) of that with most
    copies, of equals with fewest cards, then the first; color: letters, in order, that
    both a land and another card of the deck have, ``C`` for none.
    """
    known = (
        tallies(deck_cards, compiled)
        .join(F.broadcast(compiled.conditions.withColumn("kind", F.lit("condition")).withColumnRenamed("cond_id", "id")), ["kind", "id"], "left")
        .join(F.broadcast(compiled.fallbacks.withColumn("kind", F.lit("fallback")).withColumnRenamed("fallback_id", "id")), ["kind", "id"], "left")
    )
    hit = (F.col("kind") == "condition") & (F.col("n") >= F.col("need"))
    weight = F.struct((-F.col("n")).alias("minus_weight"), "n_cards", F.col("id").alias("fallback_id"), "name", "with_color")

    def letters(kind: str) -> Column:
        return F.collect_set(F.when((F.col("kind") == kind) & (F.col("n") > 0), F.col("id"))).alias(kind)

    per_rule = known.groupBy("deck_id", "rule_id").agg(
        F.count_if(hit & ~F.col("forbids")).alias("n_met"),
        F.count_if(hit & F.col("forbids")).alias("n_forbidden"),
        F.max(F.when(F.col("kind") == "entry", F.col("n"))).alias("entries"),
        F.min(F.when((F.col("kind") == "fallback") & (F.col("n") > 0), weight)).alias("fallback"),
        letters("land"),
        letters("nonland"),
    )
    marked = per_rule.join(F.broadcast(compiled.rules), "rule_id", "left")
    match = F.struct(*MATCH)
    per_deck = marked.groupBy("deck_id").agg(
        F.collect_list(F.when((F.col("n_met") > 0) & (F.col("n_met") == F.col("n_needed")) & (F.col("n_forbidden") == 0), match)).alias("matches"),
        F.collect_set(F.when(F.col("n_forbidden") > 0, F.col("rule_id"))).alias("forbidden"),
        F.max("entries").alias("entries"),
        F.min("fallback").alias("fallback"),
        F.flatten(F.collect_list("land")).alias("land"),
        F.flatten(F.collect_list("nonland")).alias("nonland"),
    )
    names = [f.split()[0] for f in RULE.split(", ")]
    kinds = dict(f.split() for f in RULE.split(", "))
    rest = [F.struct(*[F.lit(r[names.index(c)]).cast(kinds[c]).alias(c) for c in MATCH]) for r in compiled.always]
    matches = F.col("matches")
    if rest:
        matches = F.concat(matches, F.filter(F.array(*rest), lambda m: ~F.array_contains(F.col("forbidden"), m["rule_id"])))
    both = F.array_sort(F.array_intersect("land", "nonland"))
    color = F.array_join(F.transform(both, lambda k: F.substring(F.lit(COLORS), k + 1, F.lit(1))), "")
    return per_deck.select(
        "deck_id", F.array_sort(matches).alias("matches"), "entries", "fallback", F.when(color == "", F.lit("C")).otherwise(color).alias("color")
    )


def results(matches: Column) -> Column:
    """The matches that count: a matching variant stands in for its rule, and none counts without it."""
    ids = F.transform(matches, lambda m: m["rule_id"])
    parents = F.array_compact(F.transform(matches, lambda m: m["parent_id"]))
    return F.filter(
        matches,
        lambda m: F.when(m["parent_id"].isNotNull(), F.array_contains(ids, m["parent_id"])).otherwise(~F.array_contains(parents, m["rule_id"])),
    )


def rule_matches(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, rule_id) of the rules whose conditions all hold, taken by themselves."""
    return profiles(deck_cards, compiled).select("deck_id", F.explode("matches").alias("m")).select("deck_id", "m.rule_id")


def resolved_matches(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, results): the matches that count, in file order."""
    found = profiles(deck_cards, compiled).select("deck_id", results(F.col("matches")).alias("results"))
    return found.where(F.size("results") > 0)


def deck_colors(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    return profiles(deck_cards, compiled).select("deck_id", "color")


def best_fallbacks(deck_cards: DataFrame, compiled: Compiled) -> DataFrame:
    """(deck_id, name, with_color, similarity): copies of the best fallback's cards by the deck's entries; may exceed one."""
    found = profiles(deck_cards, compiled).where("fallback is not null")
    return found.select("deck_id", "fallback.name", "fallback.with_color", _similarity().alias("similarity"))


def _similarity() -> Column:
    return -F.col("fallback.minus_weight") / F.col("entries")


def classify(deck_cards: DataFrame, compiled: Compiled, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """(deck_id, archetype, variant, label, method, similarity, color, conflict) of every deck with a card.

    conflict lists the labels of all matches, in file order, if there are several;
    that with the fewest conditions wins, then the first. Decks that no rule matches
    may have a fallback; others have nulls and a colour.
    """
    first = F.array_min(F.transform("results", lambda m: F.struct(m["n_conditions"].alias("n"), m["file_order"], m["variant_order"], m.alias("m"))))["m"]
    rows = (
        profiles(deck_cards, compiled)
        .withColumn("results", results(F.col("matches")))
        .withColumn("m", first)
        .withColumn("labels", F.transform("results", lambda m: display_label(m["name"], m["with_color"], F.col("color"))))
        .withColumn("f", F.when(_similarity() > least_similarity, F.col("fallback")))
    )
    by_rule = F.col("m").isNotNull()

    def either(rule: Column, fallback: Column) -> Column:
        return F.when(by_rule, rule).otherwise(fallback)

    def label_of(x: str) -> Column:
        return display_label(F.col(f"{x}.name"), F.col(f"{x}.with_color"), F.col("color"))

    return rows.select(
        "deck_id",
        either(F.col("m.parent_name"), F.col("f.name")).alias("archetype"),
        F.when(by_rule & F.col("m.parent_id").isNotNull(), F.col("m.name")).alias("variant"),
        either(label_of("m"), label_of("f")).alias("label"),
        either(F.lit("rules"), F.when(F.col("f").isNotNull(), "fallback")).alias("method"),
        either(F.lit(1.0), F.when(F.col("f").isNotNull(), _similarity())).alias("similarity"),
        "color",
        F.when(F.size("labels") > 1, F.col("labels")).otherwise(F.array().cast("array<string>")).alias("conflict"),
    )
