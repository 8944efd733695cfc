"""Queries of win rates, backtests, alerts and rollups, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..operators import alerts, rollups, trends, winrates
from ..operators.numbering import shared_dir
from ..sources.windows import WindowLayout
from . import star
from .catalog import labelled, labelled_lines, query

DAY = "2001-08-01"
BY = ["game_id"]
#: Records of decks; wins and games of labels, faded by 60 days; and their priors.
RECORDS_SQL = (
    ", rec AS (SELECT e.game_id, e.source AS label, d.date, wins, losses, date_diff('day', DATE '1970-01-03', d.date) AS day "
    "FROM decks d JOIN ev e ON e.id = d.event_id WHERE wins IS NOT NULL AND d.date IS NOT NULL AND e.game_id IS NOT NULL AND source IS NOT NULL), "
    f"cnt AS (SELECT game_id, label, sum(wins * f) AS w, sum((wins + losses) * f) AS n FROM (SELECT *, pow(0.5, date_diff('day', date, DATE '{DAY}') / 60.0) AS f "
    f"FROM rec WHERE date < DATE '{DAY}') GROUP BY ALL)"
)


def prior_sql(counts: str, by: str) -> str:
    return (
        f"SELECT {by}, k, m, 1 / least(greatest(CASE WHEN room > 0 THEN e / room ELSE 0 END, 1e-4), 0.999) - 1 AS s FROM (SELECT {by}, count(*) AS k, sum(w) / sum(n) AS m, "
        "sum(n * (w / n) * (w / n)) - sum(n) * m * m - m * (1 - m) * (count(*) - 1) AS e, "
        f"m * (1 - m) * (sum(n) - sum(n * n) / sum(n) - count(*) + 1) AS room FROM {counts} WHERE n > 0 GROUP BY {by})"
    )


RATES_SQL = (
    RECORDS_SQL + f", pri AS ({prior_sql('cnt', 'game_id')}), rates AS (SELECT game_id, label, w, n, w + m * s AS a, n - w + (1 - m) * s AS b, (w + m * s) / (n + s) AS r FROM cnt JOIN pri USING (game_id))"
)
#: Each match of consecutive decks from both sides, by label.
PAIRS_SQL = (
    f", mt AS (SELECT e1.game_id, e1.source AS la, e2.source AS lb, a.wins > coalesce(b.wins, -1) AS won, pow(0.5, date_diff('day', a.date, DATE '{DAY}') / 60.0) AS f "
    "FROM decks a JOIN decks b ON b.id = a.id + 1 JOIN ev e1 ON e1.id = a.event_id JOIN ev e2 ON e2.id = b.event_id "
    f"WHERE a.wins IS NOT NULL AND a.date < DATE '{DAY}' AND e1.source IS NOT NULL AND e2.source IS NOT NULL), "
    "pr AS (SELECT game_id, label, against, sum(CASE WHEN won THEN f ELSE 0 END) AS w, sum(f) AS n FROM (SELECT game_id, la AS label, lb AS against, won, f FROM mt "
    "UNION ALL SELECT game_id, lb, la, NOT won, f FROM mt) GROUP BY ALL)"
)


def _records(s, d):
    ev = star.events(s, d).select(F.col("id").alias("event_id"), "game_id", F.col("source").alias("label"))
    return star.decks(s, d).join(ev, "event_id").select(*BY, "label", "date", "wins", "losses")


def _counts(s, d):
    return winrates.counted(_records(s, d), [*BY, "label"], F.lit(DAY).cast("date"), 60.0)


def _rounded(df, digits: int = 7):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(RECORDS_SQL + f" SELECT game_id, round(m, 7) AS mean, round(s, 4) AS strength, k AS labels FROM ({prior_sql('cnt', 'game_id')})")
def q_rate_prior(s, d):
    found = winrates.fit_prior(_counts(s, d), BY)
    return found.select("game_id", F.round("mean", 7).alias("mean"), F.round("strength", 4).alias("strength"), "labels")


@query(RATES_SQL + " SELECT game_id, label, round(n, 7) AS games, round(r, 7) AS rate FROM rates")
def q_shrunk_rates(s, d):
    counts = _counts(s, d)
    return _rounded(winrates.shrunk_rates(counts, winrates.fit_prior(counts, BY), BY).select("game_id", "label", "games", "rate"))


@query(
    RATES_SQL + PAIRS_SQL + ", t AS (SELECT game_id, 1 / least(greatest(CASE WHEN room > 0 THEN e / room ELSE 0 END, 1e-4), 0.999) - 1 AS t FROM (SELECT game_id, "
    "sum(pr.n * pow(pr.w / pr.n - r, 2) - r * (1 - r)) AS e, sum(r * (1 - r) * (pr.n - 1)) AS room FROM pr JOIN rates USING (game_id, label) WHERE pr.n > 0 GROUP BY 1)) "
    "SELECT game_id, label, against, round(pr.n, 7) AS games, round((pr.w + r * t) / (pr.n + t), 7) AS rate FROM pr JOIN rates USING (game_id, label) JOIN t USING (game_id)"
)
def q_shrunk_matchups(s, d):
    counts = _counts(s, d)
    rates = winrates.shrunk_rates(counts, winrates.fit_prior(counts, BY), BY)
    decks = star.decks(s, d).select("id", "event_id", "wins", "date")
    ev = star.events(s, d).select(F.col("id").alias("event_id"), "game_id", F.col("source").alias("label"))
    a = decks.join(ev, "event_id").drop("event_id")
    b = decks.join(ev.drop("game_id"), "event_id").select((F.col("id") - 1).alias("id"), F.col("wins").alias("other"), F.col("label").alias("against"))
    won = F.col("wins") > F.coalesce("other", F.lit(-1))
    played = a.join(b, "id").where("wins is not null").select(
        F.explode(F.array(*[
            F.struct("game_id", F.col(x).alias("label"), F.col(y).alias("against"), "date", w.cast("int").alias("wins"), (~w).cast("int").alias("losses"))
            for x, y, w in (("label", "against", won), ("against", "label", ~won))
        ])).alias("m")
    ).select("m.*")
    pairs = winrates.counted(played, [*BY, "label", "against"], F.lit(DAY).cast("date"), 60.0)
    found = winrates.shrunk_pairs(pairs, rates, winrates.fit_pair_strength(pairs, rates, BY), BY)
    return _rounded(found.select("game_id", "label", "against", "games", "rate"))


def _quantile_sql(level: float) -> str:
    """Halving over the power series of the incomplete beta function, taken from the nearer end."""
    mid = "((z.lo + z.hi) / 2)"
    far = f"{mid} > a / (a + b)"
    p, q, x = (f"(CASE WHEN {far} THEN {u} ELSE {v} END)" for u, v in (("b", "a"), ("a", "b"), (f"1 - {mid}", mid)))
    term = f"u.t * (a + b + v.t) / ({p} + 1 + v.t) * {x}"
    terms = (
        "list_reduce(list_prepend({'t': CAST(1 AS DOUBLE), 's': CAST(1 AS DOUBLE)}, list_transform(range(1500), lambda j: {'t': CAST(j AS DOUBLE), 's': CAST(0 AS DOUBLE)})), "
        f"lambda u, v: {{'t': {term}, 's': u.s + {term}}}).s"
    )
    part = f"exp({p} * ln({x}) + {q} * ln(1 - {x}) - ln({p}) - lgamma(a) - lgamma(b) + lgamma(a + b)) * {terms}"
    start = "{'lo': CAST(0 AS DOUBLE), 'hi': CAST(1 AS DOUBLE)}"
    return (
        f"list_reduce(list_transform(range(41), lambda x: {start}), lambda z, y: CASE WHEN (CASE WHEN {far} THEN 1 - {part} ELSE {part} END) < {level} "
        f"THEN {{'lo': {mid}, 'hi': z.hi}} ELSE {{'lo': z.lo, 'hi': {mid}}} END).lo"
    )


@query(RATES_SQL + f" SELECT game_id, label, round(r, 7) AS rate, round({_quantile_sql(0.05)}, 7) AS low, round({_quantile_sql(0.95)}, 7) AS high FROM rates")
def q_rate_intervals(s, d):
    counts = _counts(s, d)
    rates = winrates.shrunk_rates(counts, winrates.fit_prior(counts, BY), BY)
    return _rounded(winrates.with_interval(rates).select("game_id", "label", "rate", "low", "high"))


#: Forecasts of weekends, every game faded by itself; what is above a forecast's middle 90 % or below it.
def backtest_sql(fade: str) -> str:
    return (
        RECORDS_SQL + ", tests AS (SELECT game_id, label, day // 7 AS t, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses FROM rec WHERE day % 7 < 2 GROUP BY ALL HAVING sum(wins + losses) > 0), "
        "past AS (SELECT r.game_id, t, label, sum(wins * " + fade + ") AS w, sum((wins + losses) * " + fade + ") AS n "
        "FROM rec r JOIN (SELECT DISTINCT game_id, t FROM tests) USING (game_id) WHERE day < 7 * t GROUP BY ALL), "
    f"pri AS ({prior_sql('past', 'game_id, t')}), "
        "fc AS (SELECT game_id, t, DATE '1970-01-03' + INTERVAL 7 DAY * t AS saturday, label, wins, losses, wins + losses AS g, coalesce(w, 0) + m * s AS a, coalesce(n, 0) - coalesce(w, 0) + (1 - m) * s AS b, m, "
        "CASE WHEN coalesce(n, 0) > 0 THEN w / n ELSE m END AS raw FROM tests JOIN pri USING (game_id, t) LEFT JOIN past USING (game_id, t, label)), "
        "pmf AS (SELECT *, list_transform(range(wins + 1), lambda k: exp(lgamma(g + 1) - lgamma(k + 1) - lgamma(g - k + 1) + lgamma(k + a) + lgamma(g - k + b) - lgamma(g + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b))) AS f, "
        "a / (a + b) AS r FROM fc), "
        "jd AS (SELECT *, list_sum(f) - f[wins + 1] / 2 BETWEEN (1 - 0.9) / 2 AND (1 + 0.9) / 2 AS covered, -(wins * ln(least(greatest(r, 1e-9), 1 - 1e-9)) + losses * ln(1 - least(greatest(r, 1e-9), 1 - 1e-9))) AS l1, "
        "-(wins * ln(least(greatest(m, 1e-9), 1 - 1e-9)) + losses * ln(1 - least(greatest(m, 1e-9), 1 - 1e-9))) AS l2, "
        "-(wins * ln(least(greatest(raw, 1e-9), 1 - 1e-9)) + losses * ln(1 - least(greatest(raw, 1e-9), 1 - 1e-9))) AS l3 FROM pmf)"
    )


BACKTEST_SQL = backtest_sql("pow(0.5, (7 * t - day) / 14.0)")
_SUMS = (
    "CAST(sum(g) AS BIGINT) AS games, sum(l1) / sum(g) AS rate_loss, sum(l2) / sum(g) AS pooled_loss, sum(l3) / sum(g) AS raw_loss, "
    "CASE WHEN sum(g * r * r) - sum(g * r) * sum(g * r) / sum(g) > 1e-8 * sum(g) THEN (sum(r * wins) - sum(g * r) * sum(wins) / sum(g)) / (sum(g * r * r) - sum(g * r) * sum(g * r) / sum(g)) END AS slope, "
    "count(*) AS records, count(*) FILTER (covered) AS covered"
)


@query(
    BACKTEST_SQL + f" SELECT game_id, CAST(saturday AS DATE) AS saturday, games, round(rate_loss, 7) AS rate_loss, round(pooled_loss, 7) AS pooled_loss, round(raw_loss, 7) AS raw_loss, round(slope, 3) AS slope, records, covered "
    f"FROM (SELECT game_id, saturday, {_SUMS} FROM jd GROUP BY 1, 2)"
)
def q_backtest(s, d):
    found = winrates.weekly(winrates.walk_forward(_records(s, d), BY), BY)
    return _rounded(found.drop("slope")).join(found.select("game_id", "saturday", F.round("slope", 3).alias("slope")), ["game_id", "saturday"])


@query(
    BACKTEST_SQL + f", wk AS (SELECT game_id, saturday, {_SUMS} FROM jd GROUP BY 1, 2) SELECT game_id, weeks, round(better, 7) AS better, games, round(rate_loss, 7) AS rate_loss, round(pooled_loss, 7) AS pooled_loss, "
    f"round(raw_loss, 7) AS raw_loss, round(slope, 3) AS slope, round(covered / records, 7) AS coverage FROM (SELECT game_id, {_SUMS} FROM jd GROUP BY 1) "
    "JOIN (SELECT game_id, count(*) AS weeks, avg(CASE WHEN rate_loss < pooled_loss THEN 1 ELSE 0 END) AS better FROM wk GROUP BY 1) USING (game_id)"
)
def q_backtest_verdict(s, d):
    found = winrates.verdict(winrates.walk_forward(_records(s, d), BY), BY)
    return found.select(*[F.round(c, 3 if c == "slope" else 7).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def _verdict_sql(fade: str, name: str) -> str:
    """The losses of a whole backtest, as a query in parentheses."""
    return f"SELECT '{name}' AS fading, game_id, sum(l1) / sum(g) AS shrunk, sum(l3) / sum(g) AS raw, sum(l2) / sum(g) AS pooled FROM ({backtest_sql(fade).partition(', tests')[2].join(['WITH tests', ' SELECT * FROM jd'])}) GROUP BY game_id"


@query(
    RECORDS_SQL + f" SELECT fading, game_id, round(shrunk, 7) AS shrunk, round(raw, 7) AS raw, round(pooled, 7) AS pooled FROM ({_verdict_sql('pow(0.5, (7 * t - day) / 14.0)', '14 days')} UNION ALL {_verdict_sql('1.0', 'none')})"
)
def q_backtest_ablation(s, d):
    """Mean log-losses with and without shrinking, with and without fading."""
    found = []
    for name, half_life in (("14 days", 14.0), ("none", None)):
        rows = winrates.verdict(winrates.walk_forward(_records(s, d), BY, half_life), BY)
        found.append(rows.select(F.lit(name).alias("fading"), "game_id", *[F.round(c, 7).alias(new) for c, new in (("rate_loss", "shrunk"), ("raw_loss", "raw"), ("pooled_loss", "pooled"))]))
    return found[0].unionByName(found[1])


SHARES_SQL = ", sh AS (SELECT d.date, source AS label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY d.date) AS share FROM decks d JOIN ev e ON e.id = d.event_id GROUP BY 1, 2)"


@query(
    SHARES_SQL + " SELECT date, label, round(share, 9) AS share FROM (SELECT *, lag(share) OVER (PARTITION BY label ORDER BY date) AS b FROM sh) WHERE share >= 0.4 AND (b IS NULL OR b < 0.4)"
)
def q_share_alerts(s, d):
    return _rounded(alerts.share_alerts(trends.daily_share(labelled(s, d)), 0.4), 9)


@query(
    ", sh AS (SELECT date, player AS label, count(*) AS n FROM decks GROUP BY 1, 2) SELECT date, label, n FROM "
    "(SELECT *, lag(date) OVER (PARTITION BY label ORDER BY date) AS b FROM sh) WHERE b IS NULL OR date_diff('day', b, date) > 30"
)
def q_first_appearances(s, d):
    """Players that appear for the first time, or after more than thirty days."""
    return alerts.first_appearances(trends.daily_share(star.decks(s, d).select("date", F.col("player").alias("label"))), 30)


_HOLT = "{'p': x.s, 'l': 0.5 * x.s + 0.5 * (a.l + a.t), 't': 0.1 * (0.5 * x.s + 0.5 * (a.l + a.t) - a.l) + 0.9 * a.t, 'n': a.n + 1, 'e': a.e + abs(x.s - a.l - a.t), 'q': a.q + abs(x.s - a.p)}"
_HOLT_START = "{'p': s, 'l': s, 't': CAST(0 AS DOUBLE), 'n': CAST(0 AS BIGINT), 'e': CAST(0 AS DOUBLE), 'q': CAST(0 AS DOUBLE)}"


@query(
    ", wk AS (SELECT (date_diff('day', DATE '1970-01-03', d.date) // 7) AS week, source AS label, count(*) AS n FROM decks d JOIN ev e ON e.id = d.event_id GROUP BY 1, 2), "
    "sh AS (SELECT week, label, CAST(n / sum(n) OVER (PARTITION BY week) AS DOUBLE) AS s FROM wk), "
    f"f AS (SELECT label, list_reduce(list({_HOLT_START} ORDER BY week), lambda a, x: {_HOLT.replace('x.s', 'x.p')}) AS f FROM sh GROUP BY 1) "
    "SELECT label, f.n AS weeks, round(f.e / f.n, 9) AS smoothed_mae, round(f.q / f.n, 9) AS persistence_mae FROM f WHERE f.n > 0"
)
def q_share_forecasts(s, d):
    """How far forecasts of next week's share are off, against those by this week's share."""
    found = trends.forecast_errors(trends.weekly_share(labelled(s, d)))
    return found.select("label", "weeks", *[F.round(c, 9).alias(c) for c in ("smoothed_mae", "persistence_mae")])


def _cusum_sql(series: str, key: str, value: str, slack: float, limit: float, warm: int) -> str:
    """The sums by recursion from day to day."""
    step = lambda sign: f"greatest(0, {{}} {sign} z - {slack})"
    return (
        f", st AS (SELECT *, row_number() OVER w AS k, count({value}) OVER e AS cn, avg({value}) OVER e AS cm, stddev_pop({value}) OVER e AS cs FROM {series} "
        f"WINDOW w AS (PARTITION BY {key} ORDER BY date), e AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        f"zs AS (SELECT *, CASE WHEN cn >= {warm} AND cs > 1e-12 THEN ({value} - cm) / cs ELSE 0 END AS z FROM st), "
        f"cu AS (SELECT *, list_reduce(list_prepend({{'z': CAST(0 AS DOUBLE), 'u': CAST(0 AS DOUBLE), 'd': CAST(0 AS DOUBLE)}}, list({{'z': CAST(z AS DOUBLE), 'u': CAST(0 AS DOUBLE), 'd': CAST(0 AS DOUBLE)}}) OVER (PARTITION BY {key} ORDER BY date)), "
        f"lambda acc, x: {{'z': CAST(0 AS DOUBLE), 'u': {step('+').format('acc.u').replace(' z ', ' x.z ')}, 'd': {step('-').format('acc.d').replace(' z ', ' x.z ')}}}) AS c FROM zs), "
        f"al AS (SELECT *, c.u AS up, c.d AS down, CASE WHEN c.u > {limit} AND coalesce(lag(c.u) OVER w, 0) <= {limit} THEN 'up' WHEN c.d > {limit} AND coalesce(lag(c.d) OVER w, 0) <= {limit} THEN 'down' END AS alarm "
        f"FROM cu WINDOW w AS (PARTITION BY {key} ORDER BY date))"
    )


@query(
    SHARES_SQL + _cusum_sql("(SELECT * FROM sh WHERE date IS NOT NULL)", "label", "share", 0.5, 4.0, 14) + " SELECT date, label, round(share, 7) AS share, round(up, 5) AS up, round(down, 5) AS down, alarm FROM al"
)
def q_share_cusum(s, d):
    """Every day of every label, with its sums, and the alarms."""
    shares = trends.daily_share(labelled(s, d)).where("date is not null").select("label", "date", "share")
    found = alerts.cusum(shares, ["label"], "share", 0.5, 4.0)
    return found.select("date", "label", F.round("share", 7).alias("share"), F.round("up", 5).alias("up"), F.round("down", 5).alias("down"), "alarm")


@query(
    ", a AS (SELECT source AS label, card_id, d.date, CAST(avg(count) AS DOUBLE) AS copies FROM deck_cards c JOIN decks d ON d.id = c.deck_id JOIN ev e ON e.id = d.event_id WHERE d.date IS NOT NULL GROUP BY ALL)"
    + _cusum_sql("a", "label, card_id", "copies", 0.5, 2.5, 3) + " SELECT label, card_id, date, round(copies, 7) AS copies, alarm FROM al WHERE alarm IS NOT NULL"
)
def q_card_spikes(s, d):
    entries = labelled_lines(s, d).where("date is not null")
    found = alerts.card_spikes(trends.card_drift(entries, star.LINE), 2.5, 0.5, 3)
    return found.select("label", "card_id", "date", F.round("copies", 7).alias("copies"), "alarm")


# Rollups


def _refreshed(s, d, rollup, by_card=False):
    """A store after two runs, before the second of which some decks' labels had changed; and what that one did. Days are first days of months here."""
    decks = star.decks(s, d)
    labels = decks.select(F.col("id").alias("deck_id"), F.col("player").alias("label"))
    rows = rollups.labelled_rows(decks, labels, star.undated_events(s, d), star.deck_cards(s, d) if by_card else None)
    rows = rows.where("date is not null").withColumn("date", F.trunc("date", "month"))
    store = rollups.RollupStore(s, f"{shared_dir(s)}/rollups-{uuid.uuid4().hex}")
    store.refresh(rollup, rows)
    later = rows.withColumn("label", F.when(F.col("deck_id") < 300, "other").otherwise(F.col("label")))
    return store, later, store.refresh(rollup, later)


_ROLLUP_SQL = (
    ", rw AS (SELECT CAST(date_trunc('month', d.date) AS DATE) AS date, e.format_id, CASE WHEN d.id < 300 THEN 'other' ELSE player END AS label, d.id AS deck_id, wins, losses FROM decks d JOIN ev e ON e.id = d.event_id WHERE d.date IS NOT NULL)"
)


@query(_ROLLUP_SQL + " SELECT CAST(count(*) FILTER (c) AS BIGINT) AS written, CAST(0 AS BIGINT) AS emptied, CAST(count(*) FILTER (NOT c) AS BIGINT) AS kept FROM (SELECT date, bool_or(deck_id < 300) AS c FROM rw GROUP BY 1)")
def q_rollup_refresh(s, d):
    """How many days of the share table a run wrote and kept after some labels had changed."""
    return s.createDataFrame([_refreshed(s, d, rollups.SHARES)[2]], "written long, emptied long, kept long")


@query(
    _ROLLUP_SQL + " SELECT format_id, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY date, format_id), 9) AS share, date FROM rw GROUP BY date, format_id, label"
)
def q_rollup_shares(s, d):
    store, rows, _ = _refreshed(s, d, rollups.SHARES)
    return _rounded(store.read(rollups.SHARES, rows), 9)


@query(
    _ROLLUP_SQL + " SELECT format_id, label, count(*) AS decks, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, date FROM rw WHERE wins IS NOT NULL GROUP BY date, format_id, label"
)
def q_rollup_records(s, d):
    store, rows, _ = _refreshed(s, d, rollups.RECORDS)
    return store.read(rollups.RECORDS, rows)


@query(
    _ROLLUP_SQL + " SELECT format_id, label, card_id, board, count(DISTINCT rw.deck_id) AS decks, CAST(sum(count) AS BIGINT) AS copies, date FROM rw JOIN deck_cards c ON c.deck_id = rw.deck_id GROUP BY ALL"
)
def q_rollup_cards(s, d):
    store, rows, _ = _refreshed(s, d, rollups.CARDS, by_card=True)
    return store.read(rollups.CARDS, rows)


# Windows


@query(
    " SELECT c.deck_id, e.date, c.card_id, c.count, c.board FROM deck_cards c JOIN decks d ON d.id = c.deck_id JOIN ev e ON e.id = d.event_id "
    "WHERE e.date BETWEEN DATE '1995-02-15' AND DATE '1995-06-30'"
)
def q_window_layout(s, d):
    """The cards of a window of all formats, by way of tables laid out for windows."""
    layout = WindowLayout(s, f"{shared_dir(s)}/windows-{uuid.uuid4().hex}", f"windows_{uuid.uuid4().hex}", 2)
    layout.write(star.events(s, d), star.decks(s, d), star.deck_cards(s, d))
    formats = [r["id"] for r in star.formats(s, d).select("id").collect()]
    return layout.load_window(date(1995, 2, 15), date(1995, 6, 30), formats)
