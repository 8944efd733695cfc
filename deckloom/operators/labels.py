"""Labels of decks in the canonical tables: ``archetypes``, ``archetype_labels`` and the decks' own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Store
from .numbering import cut, numbered


def archetype_rows(old: DataFrame, classified: DataFrame, format_id: int, now: Column) -> DataFrame:
    """The ``archetypes`` table with all archetypes and variants of classified decks in it; known ones keep their ids.

    New names of a format get the ids after the largest one, archetypes before variants, each in order of names. A variant's parent
    is its archetype; a name that is both is one row, without a parent.
    """
    pairs = classified.where("archetype is not null").select("archetype", "variant").distinct()
    names = pairs.select(F.col("archetype").alias("name"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")).unionByName(
        pairs.where("variant is not null").select(F.col("variant").alias("name"), F.lit(1).alias("level"), F.col("archetype").alias("parent"))
    )
    one = names.groupBy("name").agg(F.min(F.struct("level", "parent")).alias("x")).select("name", "x.level", "x.parent")
    known = old.where(F.col("format_id") == format_id).select("name")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = cut(numbered(one.join(known, "name", "left_anti"), ["level", "name"], "_n").withColumn("id", (F.col("_n") + top).cast("int")))
    ids = old.where(F.col("format_id") == format_id).select(F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    ids = ids.unionByName(fresh.select(F.col("name").alias("parent"), F.col("id").alias("parent_id")))
    added = fresh.join(ids, "parent", "left").select(
        "id", F.lit(format_id).alias("format_id"), "name", F.lit("active").alias("status"), "parent_id", now.cast("timestamp").alias("created_at")
    )
    return old.unionByName(added)


def label_rows(old: DataFrame, classified: DataFrame, archetypes: DataFrame, format_id: int, version: str) -> DataFrame:
    """The ``archetype_labels`` table: the rows of other versions and decks, and one for each deck that got a label now.

    A deck that was classified before at this version and has no label now loses its row. confidence is the similarity.
    """
    ids = archetypes.where(F.col("format_id") == format_id).select("name", F.col("id").alias("archetype_id"))
    new = classified.where("archetype is not null").select("deck_id", F.coalesce("variant", "archetype").alias("name"), "method", F.col("similarity").alias("confidence"))
    new = new.join(ids, "name").select("deck_id", "archetype_id", F.lit(version).alias("classifier_version"), "method", "confidence")
    judged = classified.select("deck_id", F.lit(version).alias("classifier_version"))
    return old.join(judged, ["deck_id", "classifier_version"], "left_anti").select(*old.columns).unionByName(new)


def labelled_decks(decks: DataFrame, labels: DataFrame, classified: DataFrame, version: str) -> DataFrame:
    """The ``decks`` table with archetype_id and classifier_version of the decks that were classified; others stay as they are."""
    now = classified.select(F.col("deck_id").alias("id"), F.lit(True).alias("_judged"))
    found = labels.where(F.col("classifier_version") == version).select(F.col("deck_id").alias("id"), F.col("archetype_id").alias("_to"))
    joined = decks.join(now, "id", "left").join(found, "id", "left")
    judged = F.coalesce("_judged", F.lit(False))
    own = {"archetype_id": F.when(judged, F.col("_to")).otherwise(F.col("archetype_id")), "classifier_version": F.when(judged, F.lit(version)).otherwise(F.col("classifier_version"))}
    return joined.select(*[own[c].alias(c) if c in own else F.col(c) for c in decks.columns])


def store_labels(store: Store, classified: DataFrame, format_id: int, version: str, now: Column | None = None) -> dict[str, int]:
    """Writes what a format's classified decks are into the store; returns how many decks were judged and labelled, and the archetypes there are.

    classified: ``rules.classify``. Each table is replaced as a whole, first the archetypes, then the labels, then the decks; a run that breaks off
    is repaired by running it again, which gives the same ids.
    """
    classified = cut(classified)
    store.swap("archetypes", archetype_rows(store.read("archetypes"), classified, format_id, now if now is not None else F.current_timestamp()))
    archetypes = store.read("archetypes")
    store.swap("archetype_labels", label_rows(store.read("archetype_labels"), classified, archetypes, format_id, version))
    labels = store.read("archetype_labels")
    store.swap("decks", labelled_decks(store.read("decks"), labels, classified, version))
    counts = classified.agg(F.count(F.lit(1)).alias("decks"), F.count("archetype").alias("labelled")).first().asDict()
    return counts | {"archetypes": archetypes.where(F.col("format_id") == format_id).count()}


def current_labels(labels: DataFrame, archetypes: DataFrame, version: str) -> DataFrame:
    """(deck_id, label, parent, method, confidence) of a version."""
    names = archetypes.select(F.col("id").alias("archetype_id"), F.col("name").alias("label"), "parent_id")
    parents = archetypes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return (
        labels.where(F.col("classifier_version") == version).join(names, "archetype_id").join(parents, "parent_id", "left")
        .select("deck_id", "label", "parent", "method", "confidence")
    )
