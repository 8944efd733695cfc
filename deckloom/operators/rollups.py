"""Tables by day that readers are served from, of which a run rewrites only days that changed.

A rollup is made from rows with a date. The rows of a day are summed up to a content hash that
no order of rows or partitions changes; the hashes of the last run stand beside the rollup. A run
compares them, makes the days that are new or differ, and overwrites just their partitions; a day
whose rows are gone becomes empty. The hashes are written last and under the run's own name, so
a run that was broken off is made good by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import cut

#: Days that are filtered by value, so that scans can skip files; more are joined.
LISTED = 400


@dataclass(frozen=True)
class Rollup:
    """A table by day: how it is made from (date, ...) rows, each day from its own rows alone."""

    name: str
    make: Callable[[DataFrame], DataFrame]


def share_rollup(rows: DataFrame) -> DataFrame:
    """(format_id, label, n, share, date): how much of a format's decks of a day each label has."""
    per = rows.groupBy("date", "format_id", "label").agg(F.count_distinct("deck_id").alias("n"))
    return per.select("format_id", "label", "n", (F.col("n") / F.sum("n").over(W.partitionBy("date", "format_id"))).alias("share"), "date")


def record_rollup(rows: DataFrame) -> DataFrame:
    """(format_id, label, decks, wins, losses, date) of decks that have a record."""
    once = rows.where("wins is not null and losses is not null").select("date", "format_id", "label", "deck_id", "wins", "losses").distinct()
    return once.groupBy("date", "format_id", "label").agg(
        F.count("*").alias("decks"), F.sum("wins").cast("long").alias("wins"), F.sum("losses").cast("long").alias("losses")
    ).select("format_id", "label", "decks", "wins", "losses", "date")


def card_rollup(rows: DataFrame) -> DataFrame:
    """(format_id, label, card_id, board, decks, copies, date): in how many of a label's decks a card is, and its copies there."""
    lines = rows.where("card_id is not null")
    return lines.groupBy("date", "format_id", "label", "card_id", "board").agg(
        F.count_distinct("deck_id").alias("decks"), F.sum("count").cast("long").alias("copies")
    ).select("format_id", "label", "card_id", "board", "decks", "copies", "date")


#: The rollups of labelled decks; their rows are date, format_id, label, deck_id, wins, losses and, of those by card, card_id, board, count.
SHARES, RECORDS, CARDS = Rollup("daily_shares", share_rollup), Rollup("daily_records", record_rollup), Rollup("daily_cards", card_rollup)


def content(rows: DataFrame) -> DataFrame:
    """(date, n, low, high): the rows of each day and two sums of hashes over all their columns. Rows without a date are left out.

    Columns are taken in the order of their names. Equal days have equal sums; that different ones have, too, is as likely as
    that two random sums of 32 and of 63 bits agree.
    """
    columns = [F.col(c) for c in sorted(rows.columns)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    hashed = F.xxhash64(*columns, nulls)
    return rows.where("date is not null").groupBy("date").agg(
        F.count("*").alias("n"),
        F.sum(hashed.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
        F.sum(F.shiftrightunsigned(F.xxhash64(nulls, *columns), 32)).alias("high"),
    )


def changed_days(now: DataFrame, before: DataFrame) -> DataFrame:
    """(date, gone): days whose content differs from that before, and whether they have no rows any more."""
    b = before.select("date", *[F.col(c).alias(f"b_{c}") for c in ("n", "low", "high")])
    same = F.lit(True)
    for c in ("n", "low", "high"):
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return now.join(b, "date", "full_outer").where(~same).select("date", F.col("n").isNull().alias("gone"))


class RollupStore:
    """Rollups below one folder, each partitioned by date."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, rollup: Rollup, rows: DataFrame) -> DataFrame:
        """The rollup as it stands; ``rows``, of which only the columns are looked at, give its columns where it was never written."""
        schema = rollup.make(rows).schema
        files, make = self._files()
        if not files.exists(make(self.path(rollup.name))):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(rollup.name))

    def _known(self, name: str) -> tuple[DataFrame, list[str]]:
        """The days' content of the last run that came to its end, and the folders of all runs."""
        files, make = self._files()
        folder = make(f"{self.root}/_{name}-days")
        found = sorted(str(x.getPath()) for x in files.listStatus(folder)) if files.exists(folder) else []
        done = [x for x in found if files.exists(make(f"{x}/_SUCCESS"))]
        schema = "date date, n long, low long, high long"
        return (self.spark.read.schema(schema).parquet(done[-1]) if done else self.spark.createDataFrame([], schema)), found

    def refresh(self, rollup: Rollup, rows: DataFrame) -> dict[str, int]:
        """Brings the rollup up to date with ``rows``; returns the number of days written, emptied, and left as they were.

        Days are written by overwriting their partitions, which readers see once the job is committed. The driver sees the changed days.
        """
        now = cut(content(rows))
        before, folders = self._known(rollup.name)
        changed = changed_days(now, before).collect()  # a row a day
        written, gone = [r["date"] for r in changed if not r["gone"]], [r["date"] for r in changed if r["gone"]]
        if written:
            if len(written) <= LISTED:
                chosen = rows.where(F.col("date").isin(written))
            else:
                chosen = rows.join(F.broadcast(self.spark.createDataFrame([(d,) for d in written], "date date")), "date", "left_semi")
            # Rows of a day come together, those of a large one into several files.
            seen = Observation(f"days-{uuid.uuid4().hex}")
            made = rollup.make(chosen).hint("rebalance", "date").observe(seen, F.collect_set("date").alias("days"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.path(rollup.name))
            # Of a day without a row in the rollup no partition was overwritten.
            gone += set(written) - set(seen.get["days"])
        files, make = self._files()
        for day in gone:
            files.delete(make(f"{self.path(rollup.name)}/date={day}"), True)
        if changed or not folders:
            last = max((int(x.rsplit("/", 1)[1].split("-")[0]) for x in folders), default=0)
            now.write.parquet(f"{self.root}/_{rollup.name}-days/{last + 1:012d}-{uuid.uuid4().hex}")
            for x in folders:
                files.delete(make(x), True)
        return {"written": len(written), "emptied": len(changed) - len(written), "kept": now.count() - len(written)}


def labelled_rows(decks: DataFrame, labels: DataFrame, events: DataFrame, deck_cards: DataFrame | None = None) -> DataFrame:
    """(date, format_id, label, deck_id, wins, losses), and with ``deck_cards`` a row for each of their lines (card_id, board, count).

    labels: deck_id, label. Decks without a label count as label null. The day is that of the decks' own column date if they have one, else of the event.
    """
    own = ["date"] if "date" in decks.columns else []
    dated = events.select(F.col("id").alias("event_id"), "format_id", *([] if own else ["date"]))
    base = (
        decks.select(F.col("id").alias("deck_id"), "event_id", "wins", "losses", *own)
        .join(dated, "event_id")
        .join(labels.select("deck_id", "label"), "deck_id", "left")
        .select("date", "format_id", "label", "deck_id", "wins", "losses")
    )
    if deck_cards is None:
        return base
    return base.join(deck_cards.select("deck_id", "card_id", "board", "count"), "deck_id", "left").select(*base.columns, "card_id", "board", "count")
