"""A cleaning pipeline over ``documents``: each stage is written as Parquet and read again by the next.

1. language_id: documents without a letter, or of no clear language, go.
2. line_dedup: later copies of repeated line runs are deleted from the texts.
3. ngram_join: of each group of near copies (word 5-grams, Jaccard 0.8) one document stays.
4. decontamination: documents that hold a window of a benchmark item go.
5. tokenize: SentencePiece ids, with whether they decode to the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckloom.llm import stages
from deckloom.llm.common import remove, shared_dir

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.by_language),
    ("line_dedup", stages.without_repeated_lines),
    ("ngram_join", stages.without_near_copies),
    ("decontamination", stages.without_benchmark),
    ("tokenize", stages.tokenized),
]

#: A trained classifier, and a search by drawn hashes, have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents. What a stage left is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
