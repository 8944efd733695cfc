"""Checkpoints, and running numbers over whole tables that no single task has to count."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if given is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="deckloom-"))
    return given or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list[str], number: str = "id", before: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with a number from 1, without gaps, in the order of some columns.

    before: new columns, each the sum of a column over all rows that come earlier. The
    rows are cut into ranges; each task counts within its range, and what the ranges
    hold is summed up from one row for each of them. Rows equal in ``order`` get their
    numbers in any order.
    """
    before = before or {}
    placed = cut(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    ranges = placed.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(F.coalesce(c, F.lit(0))).alias(f"_{new}") for new, c in before.items()])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ["_rows", *(f"_{new}" for new in before)]
    offsets = ranges.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])
    inside = W.partitionBy("_part").orderBy(*order)
    # A row for each range, whose number is that of the shuffle partitions.
    out = placed.join(F.broadcast(offsets), "_part").withColumn(number, (F.row_number().over(inside) + F.col("_rows")).cast("long"))
    for new, c in before.items():
        own = F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(new, (own + F.col(f"_{new}")).cast("long"))
    return out.drop("_part", *sums)
