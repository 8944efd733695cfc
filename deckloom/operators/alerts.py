"""What subscribers are told of: shares that pass a threshold, labels that appear, and series that leave their level.

Tables of shares are those of ``trends.daily_share``: date, label, n, share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_alerts(shares: DataFrame, above: float) -> DataFrame:
    """(date, label, share): the days on which a label's share of the decks reaches ``above`` and did not on the label's day before. shares: date, label, share."""
    before = F.lag("share").over(W.partitionBy("label").orderBy("date"))
    return shares.withColumn("_before", before).where((F.col("share") >= above) & (F.col("_before").isNull() | (F.col("_before") < above))).select("date", "label", "share")


def first_appearances(shares: DataFrame, quiet: int = 0) -> DataFrame:
    """(date, label, n): the first day of each label or, with ``quiet``, also the days after so many without it. shares: date, label, n."""
    gap = F.datediff("date", F.lag("date").over(W.partitionBy("label").orderBy("date")))
    return shares.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > quiet) if quiet else F.col("_gap").isNull()).select("date", "label", "n")


def cusum(series: DataFrame, key: list[str], value: str, drift: float, limit: float, warm: int = 14) -> DataFrame:
    """``series`` (key, date, value) with up, down and alarm: cumulative sums of what lies beyond the mean of the days before.

    A day's deviation is from the mean and standard deviation of the key's earlier days, at least ``warm`` of them (else
    it counts as none, as it does where they are all equal). up is the largest sum of deviations less ``drift``
    over any run of days that ends here, 0 at least; down the same for falls. alarm tells a day on which one
    of them passes ``limit`` from below. No reset follows an alarm. Means, deviations and sums go on from day to day in
    this order, and not by differences of running sums, whose last digits would decide where a sum is just the limit. A
    series holds one row a date.
    """
    rest = [c for c in series.columns if c not in (*key, "date")]
    days = series.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("date", *rest))).alias("_days"))
    none = F.lit(0.0)

    def score(acc: Column, day: Column) -> Column:
        x, n = day[value].cast("double"), acc["n"] + F.lit(1)
        mean = acc["mean"] + (x - acc["mean"]) / n
        spread = F.sqrt(acc["q"] / acc["n"])
        z = F.when((acc["n"] >= warm) & (spread > 1e-12), (x - acc["sum"] / acc["n"]) / spread)
        after = F.struct(n.alias("n"), (acc["sum"] + x).alias("sum"), mean.alias("mean"), (acc["q"] + (x - mean) * (x - acc["mean"])).alias("q"))
        before = F.struct(*[acc[c].alias(c) for c in ("n", "sum", "mean", "q")])
        seen = F.when(x.isNull(), before).otherwise(after)
        return F.struct(*[seen[c].alias(c) for c in ("n", "sum", "mean", "q")], F.concat(acc["z"], F.array(F.coalesce(z, none))).alias("z"))

    def add(acc: Column, z: Column) -> Column:
        last = F.element_at(acc, -1)
        up, down = F.greatest(last["up"] + z - drift, none), F.greatest(last["down"] - z - drift, none)
        return F.concat(acc, F.array(F.struct(up.alias("up"), down.alias("down"))))

    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("sum"), none.alias("mean"), none.alias("q"), F.array().cast("array<double>").alias("z"))
    # The sums before the first day, then those of each day.
    sums = F.aggregate(F.aggregate("_days", start, score)["z"], F.array(F.struct(none.alias("up"), none.alias("down"))), add)
    rows = days.withColumn("_sums", sums).select(*key, "_sums", F.posexplode("_days").alias("_k", "_day"))
    was, now = F.col("_sums")[F.col("_k")], F.col("_sums")[F.col("_k") + 1]
    passed = lambda c: (now[c] > limit) & (was[c] <= limit)
    alarm = F.when(passed("up"), "up").when(passed("down"), "down")
    rows = rows.select(*key, "_day.*", now["up"].alias("up"), now["down"].alias("down"), alarm.alias("alarm"))
    return rows.select(*series.columns, "up", "down", "alarm")


def card_spikes(drift: DataFrame, limit: float = 5.0, slack: float = 0.5, warm: int = 14) -> DataFrame:
    """(label, card_id, date, copies, up, down, alarm): the days on which a card's mean copies in a label's decks leave their level. drift: label, card_id, date, copies."""
    rows = drift.select("label", "card_id", "date", "copies")
    return cusum(rows, ["label", "card_id"], "copies", slack, limit, warm).where("alarm is not null")
