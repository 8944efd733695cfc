"""Event documents as a stream: new files become rows of events, each document once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..schemas import EVENT_DOCUMENT
from ..sources.events import BROKEN, LAYOUT, marked_broken, with_path


def read_stream(spark: SparkSession, root: str, tokens: dict[str, list[str]], files_per_trigger: int = 500) -> DataFrame:
    """Documents as they come, with path columns and format; those of no single format, or that cannot be parsed, are left out."""
    docs = (
        spark.readStream.schema(f"{EVENT_DOCUMENT}, {BROKEN} string")
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(f"{root.rstrip('/')}/{LAYOUT}")
    )
    placed = with_path(marked_broken(docs).where("not broken").drop("broken")).drop("_file")
    return placed.withColumn("format", text.detect_format(F.col("slug"), tokens)).where("format is not null")


def once(docs: DataFrame, delay: str | None = None, time_col: str | None = None) -> DataFrame:
    """Documents whose source and slug were not seen before. With a time column and delay, the state of old ones is dropped."""
    if time_col is None:
        return docs.dropDuplicates(["source", "slug"])
    return docs.withWatermark(time_col, delay or "30 days").dropDuplicatesWithinWatermark(["source", "slug"])


def daily_counts(docs: DataFrame, delay: str = "7 days") -> DataFrame:
    """(day, source, events, decks) in windows of a day; late documents count until the watermark passes."""
    at = text.event_date(F.col("Tournament.Date"), F.col("path_date")).cast("timestamp")
    timed = docs.select(at.alias("at"), "source", F.coalesce(F.size("Decks"), F.lit(0)).alias("n"))
    grouped = timed.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "source")
    return grouped.agg(F.count("*").alias("events"), F.sum("n").alias("decks")).select(F.col("w.start").cast("date").alias("day"), "source", "events", "decks")


def write_batches(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch to ``write`` with its number and stops when all present files were read. A batch may come again under its number after a failure."""
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that replaces what the same batch wrote before, so each document ends up once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
