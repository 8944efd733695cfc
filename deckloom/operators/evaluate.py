"""How well clusters agree with rules: majority labels, agreement, F1, Adjusted Rand Index, emergence, determinism."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio
from .clusters import NOISE

#: Decks that make a label established; targets for agreement and F1; days to detect; appearances that make an emergence.
ESTABLISHED, AGREEMENT, LEAST_F1, HORIZON, APPEARANCES = 50, 0.95, 0.90, 7, 5


def ground_truth(classified: DataFrame) -> DataFrame:
    """(deck_id, truth) of the decks that rules label without conflict."""
    return classified.where((F.col("method") == "rules") & (F.size("conflict") == 0)).select("deck_id", F.col("archetype").alias("truth"))


def majority_labels(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, label): the label of most of a cluster's decks, of equals the first by name; null without one. Noise has none."""
    members = clustered.where(F.col("cluster") != NOISE)
    votes = members.join(truth, "deck_id").groupBy("cluster", "truth").agg(F.count("*").alias("n"))
    best = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("truth").alias("label"))).alias("b"))
    return members.select("cluster").distinct().join(best, "cluster", "left").select("cluster", F.col("b.label").alias("label"))


def predictions(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """(deck_id, cluster, truth, predicted) of the decks with a truth."""
    return truth.join(clustered, "deck_id", "left").join(majority_labels(clustered, truth), "cluster", "left").select(
        "deck_id", "cluster", "truth", F.col("label").alias("predicted")
    )


def per_label(predicted: DataFrame, least: int = ESTABLISHED) -> DataFrame:
    """(label, n, precision, recall, f1) of the labels with ``least`` decks or more; false hits count over all decks with a truth."""
    right = (F.col("truth").eqNullSafe(F.col("predicted"))).cast("int")
    both = predicted.select(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), right.alias("tp")).unionByName(
        predicted.where("predicted is not null").select(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp"))
    )
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")]).where(F.col("t") >= least)
    sums = sums.withColumn("precision", ratio(F.col("tp"), F.col("p"))).withColumn("recall", ratio(F.col("tp"), F.col("t")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return sums.select("label", F.col("t").alias("n"), "precision", "recall", f1.alias("f1"))


def agreement(predicted: DataFrame, least: int = ESTABLISHED) -> DataFrame:
    """One row: decks of established labels, those predicted right, and their share."""
    sums = predicted.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth").eqNullSafe(F.col("predicted"))).alias("r"))
    return (
        sums.where(F.col("n") >= least)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("decks"), F.coalesce(F.sum("r"), F.lit(0)).alias("agreeing"))
        .withColumn("agreement", ratio(F.col("agreeing"), F.col("decks")))
    )


def adjusted_rand(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row (n, ari): the index of two labellings; noise is a label as any other. Two labellings without choice agree fully."""
    cells = pairs.groupBy(left, right).agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / F.lit(2.0)
    a = cells.groupBy(left).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("a"), F.sum("n").alias("total"))
    b = cells.groupBy(right).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("b"))
    c = cells.agg(F.sum(two("n")).alias("c"))
    chance = F.coalesce(F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2.0), F.lit(0.0))
    top = (F.col("a") + F.col("b")) / 2.0
    # Three single rows side by side.
    return a.join(b).join(c).select(
        F.coalesce("total", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.col("c") - chance, top - chance), F.lit(1.0)).alias("ari")
    )


@dataclass(frozen=True)
class Emergence:
    target_decks: int
    first: object = None
    deadline: object = None
    detected_on: object = None
    size: int = 0
    purity: float = 0.0

    @property
    def passed(self) -> bool:
        return self.detected_on is not None


def nth_date(targets: DataFrame, n: int = APPEARANCES) -> DataFrame:
    """(first): the date of the n-th target deck; no row if there are fewer. Takes the n smallest, never sorts them all."""
    smallest = targets.orderBy("date", "deck_id").limit(n)
    return smallest.agg(F.max("date").alias("first"), F.count("*").alias("n")).where(F.col("n") == n).select("first")


def remainder(decks: DataFrame, classified: DataFrame) -> DataFrame:
    """Decks that no rule labels; those with a conflict were labelled."""
    return decks.join(classified.where(F.col("method").eqNullSafe("rules")).select("deck_id"), "deck_id", "left_anti")


def qualifying(clustered: DataFrame, targets: DataFrame, least: int = APPEARANCES) -> DataFrame:
    """(slice, cluster, size, purity) of clusters of ``least`` decks or more, more than half of them targets."""
    marked = clustered.where(F.col("cluster") != NOISE).join(targets.select("deck_id", F.lit(1).alias("hit")), "deck_id", "left")
    sizes = marked.groupBy("slice", "cluster").agg(F.count("*").alias("size"), F.count("hit").alias("hits"))
    return sizes.withColumn("purity", F.col("hits") / F.col("size")).where((F.col("size") >= least) & (F.col("purity") > 0.5)).drop("hits")


def expanding_days(first: Column, horizon: int = HORIZON) -> Column:
    """The days from the first on, the horizon's end included."""
    return F.explode(F.sequence(first, F.date_add(first, horizon)))


def emergence(decks: DataFrame, targets: DataFrame, cluster, horizon: int = HORIZON, least: int = APPEARANCES) -> Emergence:
    """Whether and when clustering what rules leave over shows a new kind of deck.

    decks: (deck_id, date) that no rule labels; targets: (deck_id, date). ``cluster``
    maps (slice, deck_id) rows to (slice, deck_id, cluster); a slice holds the decks up
    to one day, and all days are clustered in one job.
    """
    n = targets.count()
    first = nth_date(targets, least).first()
    if first is None:
        return Emergence(n)
    days = decks.sparkSession.range(1).select(expanding_days(F.lit(first[0]), horizon).alias("slice"))
    slices = decks.join(F.broadcast(days), F.col("date") <= F.col("slice")).select("slice", "deck_id")
    found = qualifying(cluster(slices), targets, least).orderBy("slice", "cluster").limit(1).first()
    end = decks.sparkSession.range(1).select(F.date_add(F.lit(first[0]), horizon)).first()[0]
    if found is None:
        return Emergence(n, first[0], end)
    return Emergence(n, first[0], end, found["slice"], found["size"], found["purity"])


def digest_sums(rows: DataFrame) -> DataFrame:
    """(n, s0, s1, s2, s3): the number of rows, and sums of four parts of the SHA-256 of each row's JSON, columns in order of their names."""
    names = sorted(rows.columns)
    hashes = rows.select(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    return hashes.agg(F.count("*").alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])


def digest(rows: DataFrame) -> str:
    """A hash of rows, whatever their order; equal results have equal ones. Only counts and sums of row hashes reach the driver."""
    names, sums = sorted(rows.columns), digest_sums(rows).first()
    return hashlib.sha256(repr([names, *map(str, sums)]).encode()).hexdigest()


def deterministic(make) -> bool:
    """Whether making a result twice gives the same rows."""
    return digest(make()) == digest(make())


def verdict(share: float, worst_f1: float | None, events: list[Emergence]) -> dict[str, bool]:
    """Results against their targets."""
    return {
        "agreement": share >= AGREEMENT,
        "f1": worst_f1 is not None and worst_f1 >= LEAST_F1,
        "emergence": bool(events) and all(e.passed for e in events),
    }


def appearances(rows: DataFrame, key: str) -> DataFrame:
    """(key, date, nth): the running number of a key's decks by date."""
    return rows.select(key, "date", "deck_id", F.row_number().over(W.partitionBy(key).orderBy("date", "deck_id")).alias("nth"))
