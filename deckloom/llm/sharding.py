"""Operator 1: shards of equal row counts in which every source has its share.

Rows of a source are shuffled by a seeded hash (MD5 of seed and id) and ranked; the rank divided by
the source's row count is a place between 0 and 1. All rows sorted by that place
interleave the sources in proportion, and a cut into equal pieces gives every
shard the mixture of the whole. No sort or window spans a source or the table: ranks
and places are numbers over ranges that a sample parts evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import aside, cut, table

OUT = ("law", "shard", "slot", "grown_shard")
#: Columns that the work itself adds for a while.
INSIDE = ["_k", "_h", "_r", "_n", "_first", "_share", "_at", "_part", "_rows"]


def interleave(
    rows: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``rows`` with law ``rows``, shard (0 to n_shards - 1), slot (gapless from 0) and a null grown_shard.

    Shard sizes differ by one row at most; so do the shares of a source from
    what its proportion asks, give or take one row for each source.

    Ranks and places are counted in sampled ranges of rows, so a task's work does not grow with the table,
    whatever rows one source, one id, or one place between 0 and 1 has; only fully equal rows stay together.

    A missing source is a source of its own. Rows that share an id are ordered by
    their other columns; fully equal rows are interchangeable. Texts are not looked
    at. Columns that the result adds replace input columns of the same name; an
    empty table gives an empty result.
    """
    given = rows.drop(*OUT)
    kept, meanwhile = aside(given, INSIDE)
    names = [F.col(meanwhile.get(c, c)).alias(c) for c in given.columns]
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    ties = [c for c, kind in kept.dtypes if not kind.startswith(("map", "variant"))]
    marks = {"_k": key, "_h": hashed}
    ranked = numbered(kept.withColumns(marks), ["_k", "_h", *ties], "_r")
    sources = ranked.groupBy("_k").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    # A source of very many rows is cut up by Spark, as both sides are plain shuffles.
    shared = ranked.join(cut(sources), "_k").withColumn("_share", (2 * (F.col("_r") - F.col("_first")) + 1) / (2 * F.col("_n")))
    total = max(1, rows.count())
    pos = F.col("_at") - 1
    shard = F.expr(f"((_at - 1) * {n_shards}) div {total}")
    slot = pos - F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (
        numbered(shared, ["_share", "_k"], "_at")
        .withColumn("law", F.lit("rows"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", slot.cast("long"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*names, *OUT)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder ``shard=i`` for each shard, its files in slot order."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return interleave(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


SQL = {
    "op1_sharding": """
WITH t AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS text,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS r, count(*) OVER (PARTITION BY k) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), k) - 1 AS pos, count(*) OVER () AS al FROM r),
s AS (SELECT *, (pos * 8) // al AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                       lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(pos - (shard * al + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM s, t
"""
}
