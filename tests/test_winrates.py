"""Priors, shrunk rates, intervals, backtests and alerts against plain readings of their definitions."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom.operators import alerts, trends, winrates

RECORD = "format string, label string, date date, wins int, losses int"


def records(seed, n=400, labels=6):
    rng = random.Random(seed)
    skill = {f"l{k}": (k + 1) / (labels + 1) for k in range(labels)}
    out = []
    for _ in range(n):
        label, games = rng.choice(list(skill)), rng.randint(0, 9)
        wins = sum(rng.random() < skill[label] for _ in range(games))
        out.append((rng.choice("ab"), label, date(2024, 1, 1) + timedelta(rng.randint(0, 100)), wins, games - wins))
    return out + [("a", None, date(2024, 1, 5), 1, 1), ("a", "l0", None, 1, 1), ("b", "l1", date(2024, 1, 5), None, None)]


def prior_of(counts):
    """(mean, strength) of {label: (won, games)} by moments."""
    rows = [(w, n) for w, n in counts.values() if n > 0]
    big = sum(n for _, n in rows)
    m = sum(w for w, _ in rows) / big
    between = sum(n * (w / n - m) ** 2 for w, n in rows) - m * (1 - m) * (len(rows) - 1)
    room = m * (1 - m) * (big - sum(n * n for _, n in rows) / big - len(rows) + 1)
    rho = min(max(between / room if room > 0 else 0, winrates.TIGHT), winrates.LOOSE)
    return m, 1 / rho - 1


def faded(rows, day, half_life):
    out = {}
    for _, label, at, wins, losses in rows:
        if label is not None and at is not None and wins is not None and at < day:
            f = 0.5 ** ((day - at).days / half_life) if half_life else 1.0
            w, n = out.get(label, (0.0, 0.0))
            out[label] = (w + wins * f, n + (wins + losses) * f)
    return out


@pytest.mark.parametrize("half_life", [14.0, None])
def test_rates_by_hand(spark, half_life):
    rows, day = records(1), date(2024, 4, 1)
    counts = winrates.counted(spark.createDataFrame(rows, RECORD), ["format", "label"], F.lit(day), half_life)
    prior = winrates.fit_prior(counts, ["format"])
    found = {(r["format"], r["label"]): r for r in winrates.shrunk_rates(counts, prior, ["format"]).collect()}
    for group in "ab":
        held = faded([r for r in rows if r[0] == group], day, half_life)
        m, s = prior_of(held)
        assert s < 1 / winrates.TIGHT - 1
        for label, (w, n) in held.items():
            r = found[group, label]
            assert math.isclose(r["rate"], (w + m * s) / (n + s), rel_tol=1e-9)
            assert min(m, w / n) - 1e-12 <= r["rate"] <= max(m, w / n) + 1e-12
            assert math.isclose(r["a"] + r["b"], n + s, rel_tol=1e-9)


def test_the_prior_finds_what_it_was_drawn_from(spark):
    rng = np.random.default_rng(3)
    p = rng.beta(12, 8, 3000)
    n = rng.integers(5, 60, 3000)
    rows = [("f", f"l{k}", float(w), float(g)) for k, (w, g) in enumerate(zip(rng.binomial(n, p), n))]
    r = winrates.fit_prior(spark.createDataFrame(rows, "format string, label string, won double, games double"), ["format"]).first()
    assert abs(r["mean"] - 0.6) < 0.01 and 17 < r["strength"] < 23.5 and r["labels"] == 3000


@pytest.mark.parametrize("rows", [[], [("f", "a", 0.0, 0.0)], [("f", "a", 3.0, 3.0)], [("f", "a", 2.0, 4.0)], [("f", "a", 5.0, 10.0), ("f", "b", 5.0, 10.0)]])
def test_priors_of_little_data(spark, rows):
    counts = spark.createDataFrame(rows, "format string, label string, won double, games double")
    found = winrates.fit_prior(counts, ["format"]).collect()
    assert [(r["mean"], round(r["strength"], 6)) for r in found] == ([(sum(x[2] for x in rows) / sum(x[3] for x in rows), 9999.0)] if sum(x[3] for x in rows) else [])


def test_pairs_shrink_towards_their_label(spark):
    rng = random.Random(5)
    rates = [("f", f"l{k}", 0.3 + k / 20) for k in range(8)]
    pairs = [("f", a[1], b[1], float(rng.randint(0, 6)), 6.0 + (a[1] == "l0") * 200) for a in rates for b in rates if a != b]
    df, own = spark.createDataFrame(pairs, "format string, label string, against string, won double, games double"), spark.createDataFrame(rates, "format string, label string, rate double")
    strength = winrates.fit_pair_strength(df, own, ["format"])
    mu = {label: r for _, label, r in rates}
    e = sum(n * (w / n - mu[a]) ** 2 - mu[a] * (1 - mu[a]) for _, a, _, w, n in pairs)
    room = sum(mu[a] * (1 - mu[a]) * (n - 1) for _, a, _, _, n in pairs)
    t = 1 / min(max(e / room, winrates.TIGHT), winrates.LOOSE) - 1
    assert math.isclose(strength.first()["pair_strength"], t, rel_tol=1e-9)
    found = {(r["label"], r["against"]): r["rate"] for r in winrates.shrunk_pairs(df, own, strength, ["format"]).collect()}
    assert len(found) == len(pairs) and all(math.isclose(found[a, b], (w + mu[a] * t) / (n + t), rel_tol=1e-9) for _, a, b, w, n in pairs)


def test_incomplete_beta_is_a_sum_of_binomials():
    for a, b, x in [(1, 1, Fraction(1, 3)), (2, 5, Fraction(1, 7)), (30, 20, Fraction(3, 5)), (1, 40, Fraction(1, 50)), (60, 3, Fraction(19, 20)), (200, 300, Fraction(2, 5))]:
        n = a + b - 1
        want = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
        assert abs(winrates.incomplete_beta(np.array([a]), np.array([b]), np.array([float(x)]))[0] - float(want)) < 1e-12
    assert winrates.incomplete_beta(np.array([2.0, 2.0]), np.array([3.0, 3.0]), np.array([0.0, 1.0])).tolist() == [0.0, 1.0]


@pytest.mark.parametrize("p", [0.05, 0.5, 0.95])
def test_quantiles(p):
    b = np.array([0.3, 1.0, 7.0, 5000.0])
    assert np.abs(winrates.beta_quantile(np.ones(4), b, p) - (1 - (1 - p) ** (1 / b))).max() < 1e-9
    assert np.abs(winrates.beta_quantile(b, np.ones(4), p) - p ** (1 / b)).max() < 1e-9
    for a, c in [(0.01, 0.02), (3.3, 4.4), (9000.0, 1000.0), (2e5, 3e5)]:
        q = winrates.beta_quantile(np.array([a]), np.array([c]), p)
        assert abs(winrates.incomplete_beta(np.array([a]), np.array([c]), q)[0] - p) < 1e-8 or q[0] < 1e-12 or q[0] > 1 - 1e-12
    assert abs(winrates.beta_quantile(np.array([4.0]), np.array([4.0]), 0.5)[0] - 0.5) < 1e-12


def test_intervals_of_rows(spark):
    rows = spark.createDataFrame([(1.0, 1.0, "x"), (None, 2.0, "y"), (0.0, 1.0, "z")], "a double, b double, low string")
    found = {r["a"]: (r["low"], r["high"]) for r in winrates.with_interval(rows, 0.9).collect()}
    assert found[None] == found[0.0] == (None, None) and np.allclose(found[1.0], (0.05, 0.95), atol=1e-12)


def rank_by_hand(won, games, a, b):
    def pmf(k):
        beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        return math.comb(games, k) * math.exp(beta(k + a, games - k + b) - beta(a, b))

    return sum(pmf(k) for k in range(won)) + pmf(won) / 2


def test_rank_of_a_record(spark):
    rows = [(w, n, a, b) for n in (1, 2, 9, 60) for w in (0, 1, n // 2, n) for a, b in ((0.5, 0.7), (3.0, 4.0), (500.0, 20.0))]
    df = spark.createDataFrame(rows, "w int, n int, a double, b double")
    for r in df.withColumn("rank", winrates.rank_of(F.col("w"), F.col("n"), F.col("a"), F.col("b"))).collect():
        assert abs(r["rank"] - rank_by_hand(*r[:4])) < 1e-9


@pytest.mark.parametrize("half_life", [14.0, None])
def test_backtest_by_hand(spark, half_life):
    rows = records(2, 300)
    df = spark.createDataFrame(rows, RECORD)
    forecasts = winrates.walk_forward(df, ["format"], half_life)
    found = {(r["format"], r["saturday"], r["label"]): r for r in forecasts.collect()}
    first, want = date(1970, 1, 3), {}
    for group in "ab":
        mine = [r for r in rows if r[0] == group and r[1] is not None and r[2] is not None and r[3] is not None]
        for week in sorted({(r[2] - first).days // 7 for r in mine}):
            saturday = first + timedelta(7 * week)
            held = faded(mine, saturday, half_life)
            if not any(n for _, n in held.values()):
                continue
            m, s = prior_of(held)
            for label in {r[1] for r in mine}:
                games = [r for r in mine if r[1] == label and 0 <= (r[2] - saturday).days < 2]
                wins, losses = sum(r[3] for r in games), sum(r[4] for r in games)
                if wins + losses:
                    w, n = held.get(label, (0.0, 0.0))
                    want[group, saturday, label] = (wins, losses, (w + m * s) / (n + s), m, w / n if n else m, w + m * s, n - w + (1 - m) * s)
    assert set(found) == set(want)
    for key, (wins, losses, *numbers) in want.items():
        r = found[key]
        assert (r["wins"], r["losses"]) == (wins, losses)
        assert np.allclose([r[c] for c in ("rate", "pooled", "raw", "a", "b")], numbers, rtol=1e-9)
    weeks = {(r["format"], r["saturday"]): r for r in winrates.weekly(forecasts, ["format"]).collect()}
    for (group, saturday), r in weeks.items():
        mine = [x for k, x in want.items() if k[:2] == (group, saturday)]
        games = sum(x[0] + x[1] for x in mine)
        assert (r["games"], r["records"]) == (games, len(mine))
        assert r["covered"] == sum(0.05 <= rank_by_hand(x[0], x[0] + x[1], x[5], x[6]) <= 0.95 for x in mine)
        for c, k in (("rate_loss", 2), ("pooled_loss", 3), ("raw_loss", 4)):
            p = [min(max(x[k], 1e-9), 1 - 1e-9) for x in mine]
            assert math.isclose(r[c], -sum(x[0] * math.log(q) + x[1] * math.log(1 - q) for x, q in zip(mine, p)) / games, rel_tol=1e-9)
    total = {r["format"]: r for r in winrates.verdict(forecasts, ["format"]).collect()}
    for group, r in total.items():
        mine = [w for k, w in weeks.items() if k[0] == group]
        assert r["weeks"] == len(mine) and math.isclose(r["better"], sum(w["rate_loss"] < w["pooled_loss"] for w in mine) / len(mine))
        assert math.isclose(r["coverage"], sum(w["covered"] for w in mine) / sum(w["records"] for w in mine))


def test_shrinking_earns_its_place_and_intervals_hold(spark):
    """Records that are drawn from the model: shrunk rates lose less than raw and pooled ones, nine of ten records lie within."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        p = rng.beta(10, 10)
        for week in range(20):
            n = int(rng.integers(1, 8))
            w = int(rng.binomial(n, p))
            rows.append(("f", f"l{k}", date(2024, 1, 6) + timedelta(7 * week), w, n - w))
    r = winrates.verdict(winrates.walk_forward(spark.createDataFrame(rows, RECORD), ["format"], None), ["format"]).first()
    assert r["rate_loss"] < r["pooled_loss"] and r["rate_loss"] < r["raw_loss"] and r["better"] > 0.8
    assert 0.85 <= r["coverage"] <= 0.97 and 0.8 <= r["slope"] <= 1.2


def test_backtest_of_nothing(spark):
    forecasts = winrates.walk_forward(spark.createDataFrame([], RECORD), ["format"])
    assert forecasts.count() == 0 and winrates.weekly(forecasts, ["format"]).count() == 0 and winrates.verdict(forecasts, ["format"]).count() == 0


def test_cusum_is_a_fold_over_days(spark):
    rng = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(80)]
    rows = [(label, d, rng.gauss(5, 1) + (3 if label == "jump" and k > 50 else -3 if label == "drop" and k > 40 else 0)) for label in ("jump", "drop", "flat") for k, d in enumerate(days)]
    rows += [("equal", d, 1.0) for d in days] + [("short", days[0], 9.0)]
    found = alerts.cusum(spark.createDataFrame(rows, "label string, date date, value double"), ["label"], "value", 0.5, 6.0, warm=10)
    by_day = {(r["label"], r["date"]): r for r in found.collect()}
    alarms = {}
    for label in ("jump", "drop", "flat", "equal", "short"):
        seen, up, down = [], 0.0, 0.0
        for _, d, x in sorted(r for r in rows if r[0] == label):
            z = (x - np.mean(seen)) / np.std(seen) if len(seen) >= 10 and np.std(seen) > 1e-12 else 0.0
            before = up, down
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            r = by_day[label, d]
            assert math.isclose(r["up"], up, abs_tol=1e-6) and math.isclose(r["down"], down, abs_tol=1e-6)
            want = "up" if up > 6 >= before[0] else "down" if down > 6 >= before[1] else None
            assert r["alarm"] == want
            if want:
                alarms.setdefault(label, []).append((want, d))
            seen.append(x)
    assert any(w == "up" and days[50] < d < days[58] for w, d in alarms["jump"]) and any(w == "down" and days[40] < d < days[48] for w, d in alarms["drop"])
    assert not {"equal", "short"} & set(alarms)


def test_share_thresholds_and_first_days(spark):
    shares = spark.createDataFrame([(date(2024, 1, k), "x", 2, s) for k, s in ((1, 0.1), (2, 0.3), (3, 0.4), (4, 0.2), (5, 0.3), (20, 0.5))] + [(date(2024, 1, 4), "y", 1, 0.9)], "date date, label string, n long, share double")
    assert sorted((r["label"], r["date"].day) for r in alerts.share_alerts(shares, 0.3).collect()) == [("x", 2), ("x", 5), ("y", 4)]
    assert sorted((r["label"], r["date"].day) for r in alerts.first_appearances(shares).collect()) == [("x", 1), ("y", 4)]
    assert sorted((r["label"], r["date"].day) for r in alerts.first_appearances(shares, 10).collect()) == [("x", 1), ("x", 20), ("y", 4)]


def test_forecasts_of_shares_walk_forward(spark):
    rng = random.Random(9)
    rows = [(date(2024, 1, 1) + timedelta(rng.randint(0, 200)), rng.choice("abc")) for _ in range(500)] + [(None, "a"), (date(2023, 1, 1), "once")]
    found = {r["label"]: r for r in trends.forecast_errors(trends.weekly_share(spark.createDataFrame(rows, "date date, label string"))).collect()}
    weeks = {}
    for d, label in rows:
        if d is not None:
            weeks.setdefault((d - date(1970, 1, 3)).days // 7, []).append(label)
    assert set(found) == {"a", "b", "c"}
    for label, r in found.items():
        series = [x.count(label) / len(x) for _, x in sorted(weeks.items()) if label in x]
        level, trend, smoothed, persistence = series[0], 0.0, 0.0, 0.0
        for before, x in zip(series, series[1:]):
            smoothed, persistence = smoothed + abs(x - level - trend), persistence + abs(x - before)
            last, level = level, 0.5 * x + 0.5 * (level + trend)
            trend = 0.1 * (level - last) + 0.9 * trend
        n = len(series) - 1
        assert r["weeks"] == n and math.isclose(r["smoothed_mae"], smoothed / n) and math.isclose(r["persistence_mae"], persistence / n)
