"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    embedding_dedup,
    fingerprints,
    language_id,
    line_dedup,
    ngram_join,
    prefix_trie,
    secrets,
    sentencepiece_codec,
    sharding,
    token_alignment,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_secrets": secrets.op5_secrets,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_warc": warc.op9_warc,
    "op10_language_id": language_id.op10_language_id,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL: dict[str, str] = {
    **sharding.SQL,
    **line_dedup.SQL,
    **decontamination.SQL,
    **sentencepiece_codec.SQL,
    **secrets.SQL,
    **embedding_dedup.SQL,
    **toxicity.SQL,
    **ngram_join.SQL,
    **warc.SQL,
    **language_id.SQL,
    **token_alignment.SQL,
    **fingerprints.SQL,
    **prefix_trie.SQL,
}
