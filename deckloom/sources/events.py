"""Event documents: JSON files at ``Tournaments/<source>/<yyyy>/<mm>/<dd>/<slug>.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..schemas import EVENT_DOCUMENT

LAYOUT = "Tournaments/*/*/*/*/*.json"
#: The column of a document's text where it could not be parsed.
BROKEN = "_broken_text"


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """One row for each file below ``root``: the document, and what its path says.

    Adds path (an array of parts from ``Tournaments`` on, whose order is the files'
    order), source, slug, path_date and raw_ref; and broken, whether the file is no JSON document
    or has a field of another type than it should, or neither a tournament nor decks.
    """
    docs = (
        spark.read.schema(f"{EVENT_DOCUMENT}, {BROKEN} string")
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("multiLine", True)
        .json(f"{root.rstrip('/')}/{LAYOUT}")
    )
    return with_path(marked_broken(docs)).drop("_file")


def marked_broken(docs: DataFrame) -> DataFrame:
    """Documents with their file, and whether they are broken instead of the text of what could not be parsed."""
    return docs.withColumn("_file", F.col("_metadata.file_path")).withColumn("broken", F.col(BROKEN).isNotNull() | (F.col("Tournament").isNull() & F.col("Decks").isNull())).drop(BROKEN)


def with_path(docs: DataFrame, file_col: str = "_file") -> DataFrame:
    parts = F.slice(F.split(F.url_decode(F.replace(F.col(file_col), F.lit("+"), F.lit("%2B"))), "/"), -6, 6)
    return (
        docs.withColumn("path", parts)
        .withColumn("source", F.col("path")[1])
        .withColumn("slug", F.regexp_replace(F.col("path")[5], r"\.[^.]*$", ""))
        .withColumn("path_date", F.array_join(F.slice("path", 3, 3), "/"))
        .withColumn("raw_ref", F.array_join("path", "/"))
    )


def select_events(docs: DataFrame, tokens: dict[str, list[str]], wanted: set[str]) -> tuple[DataFrame, DataFrame]:
    """The documents to import, and one row of counts of those that are not.

    A document counts as unknown without just one format, as other if that is not wanted, as
    broken if a column of that name says so; of the rest the first path of each source and slug stays.
    """
    marked = docs.withColumn("format", text.detect_format(F.col("slug"), tokens))
    broken = F.coalesce(F.col("broken"), F.lit(False)) if "broken" in docs.columns else F.lit(False)
    kind = (
        F.when(F.col("format").isNull(), "unknown").when(~F.col("format").isin(sorted(wanted) or [""]), "other").when(broken, "broken").otherwise("wanted")
    )
    marked = marked.withColumn("_kind", kind)
    copy = F.row_number().over(W.partitionBy("source", "slug", "_kind").orderBy("path"))
    marked = marked.withColumn("_copy", F.when(F.col("_kind") == "wanted", copy))
    counts = marked.agg(
        F.count("*").alias("files_seen"),
        F.count_if(F.col("_kind") == "unknown").alias("format_unknown"),
        F.count_if(F.col("_kind") == "other").alias("other_format"),
        F.count_if(F.col("_copy") > 1).alias("duplicate"),
        *([F.count_if(F.col("_kind") == "broken").alias("broken")] if "broken" in docs.columns else []),
    )
    return marked.where("_copy = 1").drop("_kind", "_copy", "broken"), counts
