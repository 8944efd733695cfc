"""Pipeline stages: (session, documents, folder of the tables) to documents.

Each works on all rows that it is given and returns their columns as they are, whatever
their names; only the last one adds some. doc_id and text have to be there, for the first
stage lang too; n_chars follows the text where it is there. Rows with nulls, empty texts
and repeated rows pass or go by the rules that each stage states; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, back, table
from .decontamination import find_contamination
from .language_id import keep_languages
from .line_dedup import dedup_lines
from .ngram_join import drop_near_copies
from .sentencepiece_codec import round_trip_documents


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is clear; what was learned from ``lang`` of the training folds decides."""
    return keep_languages(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without later copies of repeated line runs, and n_chars as the new texts have it."""
    rows, meanwhile = aside(docs, ["n_lines", "n_deleted", "n_runs"])
    new = {}
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        new["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return back(dedup_lines(rows), docs, meanwhile, **new)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; of equal texts without a word one stays, too."""
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, meanwhile = aside(docs, ["n_words", "spans", "items"])
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"))
    return back(found.where(F.size("spans") == 0), docs, meanwhile)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_ids, and round_trip: whether the ids decode to the text. Columns that have one of these names are replaced."""
    rows, meanwhile = aside(docs, ["decoded_crc32"])
    found = round_trip_documents(rows)
    names = {v: k for k, v in meanwhile.items()}
    return found.select(*[F.col(c).alias(names.get(c, c)) for c in found.columns if c != "decoded_crc32"])
