"""A layout of decks and their cards for windows of days: what is read together lies together.

Both tables are partitioned by format and month, so a window reads the folders of its months only, and
bucketed by deck with as many buckets, so joining them moves nothing. They are made from the canonical tables
and belong to them as an index does. Their definitions live in the session's catalogue; another session
declares them over the same files.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of both tables; format_id and month are the partitions.
COLUMNS = {
    "decks": "deck_id bigint, date date, format_id int, month string",
    "deck_cards": "deck_id bigint, card_id bigint, count int, board string, format_id int, month string",
}
BUCKETS = 64


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


class WindowLayout:
    """Both tables below a folder, under names that begin with ``name`` in the session's catalogue. ``buckets`` has to be what they were written with."""

    def __init__(self, spark: SparkSession, root: str, name: str = "windows", buckets: int = BUCKETS):
        self.spark, self.root, self.name, self.buckets = spark, root.rstrip("/"), name, buckets

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def write(self, events: DataFrame, decks: DataFrame, deck_cards: DataFrame) -> None:
        """Lays the tables out anew. events: id, format_id, date; decks: id, event_id; deck_cards: deck_id, card_id, count, board.

        Decks of events without a format or date are in no window and left out. Each month of a format gets up to ``buckets`` files.
        """
        placed = events.where("format_id is not null and date is not null").select(F.col("id").alias("event_id"), F.col("format_id").cast("int").alias("format_id"), "date")
        own = decks.select(F.col("id").cast("long").alias("deck_id"), "event_id").join(placed, "event_id").withColumn("month", _month(F.col("date")))
        lines = deck_cards.join(own.select("deck_id", "format_id", "month"), "deck_id")
        for part, rows in (("decks", own), ("deck_cards", lines)):
            fields = [x.split() for x in COLUMNS[part].split(", ")]
            typed = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields])
            # Rows of a format's month and bucket come from one task, so that they are one file; a task has no whole bucket.
            dealt = typed.repartition("format_id", "month", F.pmod(F.hash("deck_id"), F.lit(self.buckets)))
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(part)}")
            writer = dealt.write.format("parquet").mode("overwrite").partitionBy("format_id", "month").bucketBy(self.buckets, "deck_id").sortBy("deck_id")
            writer.option("path", f"{self.root}/{part}").saveAsTable(self._table(part))

    def declare(self) -> None:
        """Tells the session's catalogue of tables that another session wrote."""
        for part, columns in COLUMNS.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(part)}")
            self.spark.sql(
                f"CREATE TABLE {self._table(part)} ({columns}) USING parquet PARTITIONED BY (format_id, month) "
                f"CLUSTERED BY (deck_id) SORTED BY (deck_id) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{part}'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {self._table(part)}")

    def _part(self, part: str, start: date, end: date, format_ids: list[int]) -> DataFrame:
        inside = F.col("month").between(F.date_format(F.lit(start), "yyyy-MM"), F.date_format(F.lit(end), "yyyy-MM"))
        return self.spark.table(self._table(part)).where(inside & F.col("format_id").isin(format_ids))

    def window_decks(self, start: date, end: date, format_ids: list[int]) -> DataFrame:
        """(deck_id, date) of formats' decks between two days, both included, also those without a card."""
        days = F.col("date").between(F.lit(start), F.lit(end))
        return self._part("decks", start, end, format_ids).where(days).select("deck_id", "date")

    def load_window(self, start: date, end: date, format_ids: list[int]) -> DataFrame:
        """(deck_id, date, card_id, count, board) of the cards of ``window_decks``, by a join within buckets."""
        lines = self._part("deck_cards", start, end, format_ids)
        return lines.join(self.window_decks(start, end, format_ids), "deck_id").select("deck_id", "date", "card_id", "count", "board")

    def drop(self) -> None:
        """Takes the tables out of the catalogue; their files stay."""
        for part in COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(part)}")
