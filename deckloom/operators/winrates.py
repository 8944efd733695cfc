"""Win rates that share strength: priors fitted from the data, rates in two levels, intervals, and a backtest by weeks.

A label's rate is drawn from a prior of its group (a format), a Beta distribution whose
mean and strength are the group's moments; a pair's rate from one around its label's own rate.
Counts fade with age. All groups, and all weeks of a backtest, are worked on in one job
over sums of a label and week, never over single games.

Tables of records: the ``by`` columns, label, date, wins, losses; of pairs also against. Rows
without a date, a label or a record are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the correlation between two games of one label; strength is 1 / correlation - 1.
LOOSE, TIGHT = 0.999, 1e-4
#: A Saturday; days from one on that are tested.
SATURDAY, WEEKEND = "1970-01-03", 2
#: Rates in a logarithm stay this far from 0 and 1.
EDGE = 1e-9
#: Variance of forecasts up to which they count as equal.
FLAT = 1e-8


def counted(rows: DataFrame, keys: list[str], as_of: Column, half_life: float | None = 14.0) -> DataFrame:
    """(keys, won, games): wins and games before a day, weights halving every ``half_life`` days (None: they stay)."""
    age = F.datediff(as_of, F.col("date"))
    weight = F.pow(F.lit(0.5), age / F.lit(half_life)) if half_life else F.lit(1.0)
    known = rows.where(age > 0).where(" and ".join(f"{c} is not null" for c in (*keys, "wins", "losses")))
    return known.groupBy(*keys).agg(F.sum(weight * F.col("wins")).alias("won"), F.sum(weight * (F.col("wins") + F.col("losses"))).alias("games"))


def _strength(excess: Column, room: Column) -> Column:
    """1 / correlation - 1, where ``excess`` is the variance beyond that of single games and ``room`` what a correlation of 1 would give."""
    rho = F.when(room > 0, excess / room).otherwise(0.0)
    return 1 / F.least(F.greatest(rho, F.lit(TIGHT)), F.lit(LOOSE)) - 1


def fit_prior(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, strength, labels): each group's prior by the moments of its labels' rates. counts: by, label, won, games.

    Where the rates differ no more than chance has it, the strength is the largest, 1 / TIGHT - 1.
    """
    sums = counts.where("games > 0").groupBy(*by).agg(
        F.count("*").alias("labels"), F.sum("won").alias("w"), F.sum("games").alias("n"),
        F.sum(F.col("won") * F.col("won") / F.col("games")).alias("ww"), F.sum(F.col("games") * F.col("games")).alias("nn"),
    )
    mean, more = F.col("w") / F.col("n"), F.col("labels") - 1
    single = mean * (1 - mean)
    excess = F.col("ww") - F.col("w") * mean - single * more
    return sums.select(*by, mean.alias("mean"), _strength(excess, single * (F.col("n") - F.col("nn") / F.col("n") - more)).alias("strength"), "labels")


def shrunk_rates(counts: DataFrame, prior: DataFrame, by: list[str]) -> DataFrame:
    """``counts`` with rate, and a and b of its Beta distribution, shrunk towards the group's mean."""
    rows = counts.join(prior, by)
    a = F.col("won") + F.col("mean") * F.col("strength")
    b = F.col("games") - F.col("won") + (1 - F.col("mean")) * F.col("strength")
    return rows.select(*counts.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate"))


def fit_pair_strength(pairs: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """(by, pair_strength): how closely pairs' rates follow their label's. pairs: by, label, against, won, games; rates: by, label, rate."""
    n, p, mu = F.col("games"), F.col("won") / F.col("games"), F.col("rate")
    rows = pairs.where("games > 0").join(rates.select(*by, "label", "rate"), [*by, "label"])
    single = mu * (1 - mu)
    sums = rows.groupBy(*by).agg(F.sum(n * (p - mu) * (p - mu) - single).alias("e"), F.sum(single * (n - 1)).alias("r"))
    return sums.select(*by, _strength(F.col("e"), F.col("r")).alias("pair_strength"))


def shrunk_pairs(pairs: DataFrame, rates: DataFrame, strength: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` with a, b and rate, shrunk towards the label's own rate. A label's mirror match, if given, is a pair like others."""
    rows = pairs.join(rates.select(*by, "label", F.col("rate").alias("own")), [*by, "label"]).join(strength, by)
    a = F.col("won") + F.col("own") * F.col("pair_strength")
    b = F.col("games") - F.col("won") + (1 - F.col("own")) * F.col("pair_strength")
    return rows.select(*pairs.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate"))


# Intervals


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distribution function of Beta(a, b) at x, by its continued fraction (evaluated from the front, after Lentz)."""
    a, b, x = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    ends = (z <= 0) | (z >= 1)
    z = np.where(ends, 0.5, z)
    lgamma = np.vectorize(math.lgamma, otypes=[np.float64])
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    found = d.copy()
    # The fraction settles after some sqrt(a + b) steps.
    for m in range(1, 200 + int(10 * math.sqrt(float((a + b).max(initial=1.0))))):
        before = found
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            found = found * c * d
        if (np.abs(found - before) <= 1e-15 * np.abs(found)).all():
            break
    out = np.where(ends, np.where(np.where(turned, 1 - x, x) <= 0, 0.0, 1.0), front * found)
    return np.where(turned, 1 - out, out)


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Where the distribution function of Beta(a, b) is p, by halving."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        below = incomplete_beta(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def with_interval(rates: DataFrame, level: float = 0.9) -> DataFrame:
    """``rates`` (a, b) with low and high: the middle ``level`` of each Beta distribution. Rows are those of labels or pairs, in Arrow batches."""

    @F.pandas_udf("low double, high double")
    def ends(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = (a > 0) & (b > 0)
        out = pd.DataFrame({"low": np.nan, "high": np.nan}, index=a.index).astype("float64")
        for name, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2)):
            out.loc[known, name] = beta_quantile(a[known].to_numpy(), b[known].to_numpy(), p)
        return out

    own = [c for c in rates.columns if c not in ("low", "high")]
    found = rates.withColumn("_ends", ends(F.col("a").cast("double"), F.col("b").cast("double")))
    return found.select(*own, *[F.nanvl(F.col(f"_ends.{c}"), F.lit(None).cast("double")).alias(c) for c in ("low", "high")])


def rank_of(won: Column, games: Column, a: Column, b: Column) -> Column:
    """The chance that a new record of so many games has fewer wins, and half that of as many: beta-binomial, from the first term on."""
    none = F.aggregate(F.sequence(F.lit(0), games.cast("int") - 1), F.lit(0.0), lambda s, j: s + F.log((b + j) / (a + b + j)))
    start = F.struct(none.alias("log"), F.lit(0.0).alias("below"))

    def step(acc: Column, k: Column) -> Column:
        ratio = F.log((games - k) * (a + k) / ((k + 1) * (b + games - k - 1)))
        return F.struct((acc["log"] + ratio).alias("log"), (acc["below"] + F.exp(acc["log"])).alias("below"))

    ks = F.when(won > 0, F.sequence(F.lit(0), won.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, start, step, lambda acc: acc["below"] + F.exp(acc["log"]) / 2)


# Backtest


def walk_forward(records: DataFrame, by: list[str], half_life: float | None = 14.0) -> DataFrame:
    """Forecasts of each weekend from all games before its Saturday, a row for each group, weekend and label that played.

    Returns the ``by`` columns, saturday, label, wins, losses, and as of that Saturday rate
    (shrunk), pooled (the group's rate), raw (the label's own, or pooled without games), a and b.
    Weekends before a group's first week with games are not tested.

    Games are summed up by label and week first, faded to the week's end; a weekend then adds up the weeks before
    it, faded by whole weeks, which is the same as fading every game. The join by ranges of weeks grows with the
    square of the number of weeks, but not with the number of games.
    """
    day = F.datediff("date", F.lit(SATURDAY).cast("date"))
    week, at = F.floor(day / 7).cast("int"), F.pmod(day, F.lit(7))
    fade = lambda days: F.pow(F.lit(0.5), days / F.lit(half_life)) if half_life else F.lit(1.0)
    known = records.where(" and ".join(f"{c} is not null" for c in (*by, "label", "date", "wins", "losses")))
    games, tested = F.col("wins") + F.col("losses"), at < WEEKEND
    weeks = known.groupBy(*by, "label", week.alias("week")).agg(
        F.sum(F.col("wins") * fade(7 - at)).alias("w"), F.sum(games * fade(7 - at)).alias("n"),
        F.sum(F.when(tested, F.col("wins"))).alias("wins"), F.sum(F.when(tested, F.col("losses"))).alias("losses"),
    )
    tests = weeks.where("wins + losses > 0")
    days = tests.select(*by, F.col("week").alias("test")).distinct()
    past = weeks.join(days, by).where("week < test")
    age = fade(7 * (F.col("test") - F.col("week") - 1))
    counts = past.groupBy(*by, "test", "label").agg(F.sum(F.col("w") * age).alias("won"), F.sum(F.col("n") * age).alias("games"))
    group = [*by, "test"]
    prior = fit_prior(counts, group)
    rows = tests.select(*by, F.col("week").alias("test"), "label", "wins", "losses").join(prior, group).join(counts, [*group, "label"], "left")
    won, n = F.coalesce("won", F.lit(0.0)), F.coalesce("games", F.lit(0.0))
    a, b = won + F.col("mean") * F.col("strength"), n - won + (1 - F.col("mean")) * F.col("strength")
    return rows.select(
        *by, F.date_add(F.lit(SATURDAY).cast("date"), F.col("test") * 7).alias("saturday"), "label", "wins", "losses",
        (a / (a + b)).alias("rate"), F.col("mean").alias("pooled"), F.when(n > 0, won / n).otherwise(F.col("mean")).alias("raw"), a.alias("a"), b.alias("b"),
    )


def _losses() -> list[Column]:
    def loss(c: str) -> Column:
        p = F.least(F.greatest(F.col(c), F.lit(EDGE)), F.lit(1 - EDGE))
        return -(F.col("wins") * F.log(p) + F.col("losses") * F.log(1 - p))

    n = F.col("wins") + F.col("losses")
    sums = [F.sum(n).alias("games"), *[F.sum(loss(c)).alias(f"{c}_loss") for c in ("rate", "pooled", "raw")]]
    r, y = F.col("rate"), F.col("wins")
    return [*sums, F.sum(n * r).alias("sr"), F.sum(n * r * r).alias("srr"), F.sum(y).alias("sy"), F.sum(r * y).alias("sry"), F.count("*").alias("records"), F.count_if("covered").alias("covered")]


def _judged(forecasts: DataFrame, by: list[str], level: float) -> DataFrame:
    rank = rank_of(F.col("wins"), F.col("wins") + F.col("losses"), F.col("a"), F.col("b"))
    inside = forecasts.withColumn("covered", rank.between((1 - level) / 2, (1 + level) / 2))
    sums = inside.groupBy(*by).agg(*_losses())
    n = F.col("games")
    spread = F.col("srr") - F.col("sr") * F.col("sr") / n
    slope = F.when(spread > FLAT * n, (F.col("sry") - F.col("sr") * F.col("sy") / n) / spread)
    return sums.select(*by, "games", *[(F.col(c) / n).alias(c) for c in ("rate_loss", "pooled_loss", "raw_loss")], slope.alias("slope"), "records", "covered")


def weekly(forecasts: DataFrame, by: list[str], level: float = 0.9) -> DataFrame:
    """(by, saturday, games, rate_loss, pooled_loss, raw_loss, slope, records, covered): a row for each tested weekend.

    Losses are the mean log-loss of a game; slope that of outcomes on forecasts (null where these are equal); covered counts
    the labels whose record lies in the middle ``level`` of what was forecast.
    """
    return _judged(forecasts, [*by, "saturday"], level)


def verdict(forecasts: DataFrame, by: list[str], level: float = 0.9) -> DataFrame:
    """(by, weeks, better, games, losses, slope, coverage): the whole backtest; better is the share of weekends with a smaller loss than the pooled rate's."""
    weeks = weekly(forecasts, by, level).groupBy(*by).agg(F.count("*").alias("weeks"), F.avg((F.col("rate_loss") < F.col("pooled_loss")).cast("double")).alias("better"))
    return _judged(forecasts, by, level).join(weeks, by).select(
        *by, "weeks", "better", "games", "rate_loss", "pooled_loss", "raw_loss", "slope", (F.col("covered") / F.col("records")).alias("coverage")
    )
