"""The canonical tables as views of a star schema, in DataFrames and in SQL.

Regions are games, nations formats, parts cards, customers events, orders decks,
and line items the decks' cards: finished lines the main zone, open ones the side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.definitions import Condition, Definitions, Fallback, Rule


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def formats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("game_id"), F.col("n_name").alias("name"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    split = F.col("p_partkey") % 7 == 0
    name = F.when(split, F.concat_ws(" // ", "p_name", "p_brand")).otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey") % 500))
    attrs = F.struct(
        F.lit("normal").alias("layout"), F.col("p_brand").alias("set_type"), F.col("p_type").alias("type_line"),
        F.lit(0).alias("resolution_tier"), F.when(split, F.array("p_name", "p_brand")).alias("face_names"),
    )
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("game_id"),
        F.col("p_partkey").cast("string").alias("canonical_ref"), name.alias("name"), attrs.alias("attrs"),
    )


def undated_events(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("type-"), F.col("c_custkey") % 5))
    return rows.select(
        F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("game_id"), F.col("c_mktsegment").alias("source"),
        F.col("c_name").alias("source_event_id"), F.col("c_nationkey").alias("format_id"), kind.alias("event_type"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.col("o_orderdate").cast("date")).alias("date"))
    rows = undated_events(spark, d).join(days, "id", "left")
    return rows.select("id", "game_id", "source", "source_event_id", "format_id", "date", "event_type")


def decks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event_id"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 97).alias("player"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 8).cast("int")).alias("wins"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 3).cast("int")).alias("losses"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


def card_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of cards; those equal in ``LINE`` sum up to one of ``deck_cards``."""
    board = F.when(F.col("l_linestatus") == "F", "main").otherwise("side")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id"), board.alias("board"), F.col("l_quantity").cast("bigint").alias("count")
    )


LINE = ["deck_id", "card_id", "board"]


def deck_cards(spark: SparkSession, d: str, decks: DataFrame | None = None) -> DataFrame:
    """The cards of all decks, or of some (deck_id): then lines of others go before any are summed, in a join that holds only the decks in memory."""
    lines = card_lines(spark, d)
    if decks is not None:
        lines = lines.join(decks.select("deck_id").hint("shuffle_hash"), "deck_id", "left_semi")
    return lines.groupBy(*LINE).agg(F.sum("count").alias("count"))


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one type stand for names without a card."""
    lost = cards(spark, d).where(F.col("attrs.type_line") == "ECONOMY").select(F.col("id").alias("card_id"), "name")
    rows = deck_cards(spark, d).join(lost, "card_id")
    return rows.groupBy(F.col("name").alias("card_name")).agg(
        F.count("*").alias("occurrences"), F.count_distinct("deck_id").alias("decks_affected")
    )


#: Formats of the documents below, and that which is wanted.
TOKENS, WANTED = {"modern": ["modern"], "legacy": ["legacy"]}, {"modern"}


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as event documents, as ``read_events`` gives them: their orders are decks, the line items the cards.

    Players repeat within an event; every second order has a standing, some for
    players without a deck, some with a null field; names are written in two ways.
    """
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    name = F.concat(F.when(F.col("l_linenumber") == 3, "CARD ").otherwise("Card "), F.col("l_partkey") % 300)
    line = F.struct("l_linenumber", F.struct(name.alias("CardName"), (F.col("l_quantity").cast("int") - 5).alias("Count")).alias("line"))
    zone = lambda status, c: F.transform(
        F.array_sort(F.collect_list(F.when((F.col("l_linestatus") == "F") == F.lit(status), line))), lambda x: x["line"]
    ).alias(c)
    zones = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(zone(True, "Mainboard"), zone(False, "Sideboard"))
    player = F.when(o % 11 != 0, F.concat(F.lit("p"), o % 5))
    result = F.when(o % 3 == 0, F.concat_ws("-", o % 6, o % 4)).when(o % 3 == 1, F.concat(o % 9 + 1, F.lit("th Place"))).otherwise("")
    stands = F.when(o % 6 == 0, F.concat(F.lit("q"), o % 5)).otherwise(player)
    wins = F.when(o % 4 == 0, "null").otherwise((o % 7).cast("string"))
    standing = F.concat(
        F.lit('{"Player": '), F.coalesce(F.concat(F.lit('"'), stands, F.lit('"')), F.lit("null")), F.lit(', "Rank": '), (o % 16).cast("string"),
        F.lit(', "Wins": '), wins, F.lit("}"),
    )
    deck = F.struct(
        F.lit(None).cast("string").alias("Date"), player.alias("Player"), result.alias("Result"), F.lit("").alias("AnchorUri"), "Mainboard", "Sideboard"
    )
    against = F.struct(player.alias("Player1"), F.concat(F.lit("p"), (o + 1) % 5).alias("Player2"), F.concat(F.lit("2-"), o % 3).alias("Result"))
    match = F.struct(F.concat(F.lit("R"), o % 3).alias("RoundName"), F.array(against).alias("Matches"))
    held = read(spark, d, "orders").join(zones, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", deck.alias("x")))).alias("d"),
        F.array_sort(F.collect_list(F.when(o % 2 == 0, F.struct("o_orderkey", standing.alias("x"))))).alias("s"),
        F.array_sort(F.collect_list(F.struct("o_orderkey", match.alias("x")))).alias("r"),
    )
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int")).cast("string")
    written = F.when(k % 3 == 0, F.concat(day, F.lit("T23:30:00-08:00"))).when(k % 3 == 1, day).otherwise("junk")
    slug = F.concat(F.when(k % 10 == 9, "legacy-").when(k % 10 == 8, "modern-legacy-").otherwise("modern-"), k % 1000)
    path = F.array(F.lit("Tournaments"), "c_mktsegment", F.lpad(k.cast("string"), 10, "0"), F.lit("01"), F.lit("01"), F.concat(slug, F.lit(".json")))
    return read(spark, d, "customer").join(held, "c_custkey", "left").select(
        F.struct(written.alias("Date"), F.col("c_name").alias("Name"), F.lit("").alias("Uri")).alias("Tournament"),
        F.transform("d", lambda x: x["x"]).alias("Decks"),
        F.transform("s", lambda x: F.parse_json(x["x"])).alias("Standings"),
        F.transform("r", lambda x: x["x"]).alias("Rounds"),
        path.alias("path"), F.col("c_mktsegment").alias("source"), slug.alias("slug"), F.lit("2001/02/03").alias("path_date"), F.array_join(path, "/").alias("raw_ref"),
    )


#: The documents in SQL: docs, those kept, their decks (od), last standings (st) and card lines (cl).
DOCUMENTS_SQL = """
WITH docs AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS source,
  CASE c_custkey % 10 WHEN 9 THEN 'legacy-' WHEN 8 THEN 'modern-legacy-' ELSE 'modern-' END || (c_custkey % 1000) AS slug FROM customer),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY k) AS copy FROM docs WHERE k % 10 < 8) WHERE copy = 1),
n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
num AS (SELECT kept.*, coalesce(n, 0) AS n, row_number() OVER w AS id, 'Tournaments/' || source || '/' || lpad(CAST(k AS VARCHAR), 10, '0') || '/01/01/' || slug || '.json' AS raw_ref,
  CAST(1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_deck FROM kept LEFT JOIN n USING (k) WINDOW w AS (ORDER BY source, k)),
od AS (SELECT num.k, num.id AS event_id, o_orderkey AS o, first_deck + row_number() OVER (PARTITION BY num.k ORDER BY o_orderkey) - 1 AS id,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'p' || (o_orderkey % 5) END AS player FROM num JOIN orders ON o_custkey = num.k),
st AS (SELECT event_id, player, max(o) AS o FROM (SELECT event_id, o, CASE WHEN o % 6 = 0 THEN 'q' || (o % 5) ELSE player END AS player FROM od WHERE o % 2 = 0) WHERE player IS NOT NULL GROUP BY 1, 2),
cl AS (SELECT od.id AS deck_id, od.event_id, CASE WHEN l_linenumber = 3 THEN 'CARD ' ELSE 'Card ' END || (l_partkey % 300) AS name, CASE WHEN l_linestatus = 'F' THEN 'main' ELSE 'side' END AS board,
  CAST(sum(CAST(l_quantity AS INTEGER) - 5) AS INTEGER) AS count, l_partkey % 300 AS card FROM od JOIN lineitem ON l_orderkey = o GROUP BY ALL)
"""


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "games": games(spark, d), "formats": formats(spark, d), "cards": cards(spark, d), "events": events(spark, d),
        "decks": decks(spark, d), "deck_cards": deck_cards(spark, d),
    }


#: The same views in SQL, to stand before a query.
SQL = """
WITH RECURSIVE games AS (SELECT r_regionkey AS id, r_name AS name FROM region),
formats AS (SELECT n_nationkey AS id, n_regionkey AS game_id, n_name AS name FROM nation),
cards AS (SELECT p_partkey AS id, CAST(p_partkey % 5 AS INTEGER) AS game_id, CAST(p_partkey AS VARCHAR) AS canonical_ref,
                 CASE WHEN p_partkey % 7 = 0 THEN p_name || ' // ' || p_brand ELSE p_name || ' ' || (p_partkey % 500) END AS name,
                 p_type AS type_line, CASE WHEN p_partkey % 7 = 0 THEN [p_name, p_brand] END AS face_names FROM part),
ev AS (SELECT c_custkey AS id, n_regionkey AS game_id, c_mktsegment AS source, c_name AS source_event_id, c_nationkey AS format_id, date,
              CASE WHEN c_acctbal >= 0 THEN 'type-' || (c_custkey % 5) END AS event_type
       FROM customer JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY 1) ON c_custkey = o_custkey),
decks AS (SELECT o_orderkey AS id, o_custkey AS event_id, 'p' || (o_orderkey % 97) AS player,
                 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 8 AS INTEGER) END AS wins,
                 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 3 AS INTEGER) END AS losses, CAST(o_orderdate AS DATE) AS date FROM orders),
deck_cards AS (SELECT l_orderkey AS deck_id, l_partkey AS card_id, CASE WHEN l_linestatus = 'F' THEN 'main' ELSE 'side' END AS board,
                      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2, 3),
unresolved AS (SELECT name AS card_name, count(*) AS occurrences, count(DISTINCT deck_id) AS decks_affected
               FROM deck_cards JOIN cards ON card_id = id WHERE type_line = 'ECONOMY' GROUP BY 1),
sizes AS (SELECT d.id, d.event_id, CAST(coalesce(sum(count) FILTER (board = 'main'), 0) AS BIGINT) AS main,
                 CAST(coalesce(sum(count) FILTER (board = 'side'), 0) AS BIGINT) AS side
          FROM decks d LEFT JOIN deck_cards c ON c.deck_id = d.id GROUP BY 1, 2)
"""

#: Rules over part numbers: (name, with colour, conditions (kind, first card, end, how often each is listed), variants). A pair of equal ends lists nothing.
RULES = [
    ("GenericAggro", True, [("OneOrMoreInMainboard", 0, 400)], [
        ("RedAggro", False, [("OneOrMoreInSideboard", 0, 1000)]), ("Blue2Aggro", True, [("TwoOrMoreInMainOrSideboard", 0, 600)]),
    ]),
    ("MidRange", False, [("TwoOrMoreInMainboard", 0, 900), ("DoesNotContain", 1000, 1040)], []),
    ("OpenUWSide", True, [("InSideboard", 600, 700), ("InMainboard", 0, 0)], []),
    ("BigControl", True, [("OneOrMoreInMainOrSideboard", 1200, 1700), ("DoesNotContainMainboard", 0, 700)], []),
    ("NothingLow", False, [("DoesNotContainSideboard", 0, 1990), ("DoesNotContainMainboard", 0, 1500)], []),
    ("Impossible", False, [("TwoOrMoreInMainboard", 5, 6)], []),
    ("CertainThree", True, [("InMainboard", 0, 250), ("InMainOrSideboard", 300, 900)], [("SideTwo", False, [("TwoOrMoreInSideboard", 0, 1200)])]),
    ("TwiceListed", False, [("TwoOrMoreInSideboard", 40, 90, 2)], []),
]
FALLBACKS = [("GenericPile", True, 0, 300), ("OtherStuff", False, 200, 800), ("ThirdPile", True, 800, 1100)]
COLORED = 2000


def land_color(card: int) -> str:
    return "WUBRG"[card % 5] if card % 3 == 0 else ""


def nonland_color(card: int) -> str:
    return "" if card % 3 != 1 else "WUBRG"[(card // 3) % 5] + ("G" if card % 17 == 0 and (card // 3) % 5 != 4 else "")


def definitions() -> Definitions:
    def rule(name: str, with_color: bool, conditions: list, variants: list = ()) -> Rule:
        made = tuple(Condition(k, tuple(range(a, b)) * (more or [1])[0], (b - a) * (more or [1])[0]) for k, a, b, *more in conditions)
        return Rule(name, with_color, made, tuple(rule(*v) for v in variants))

    return Definitions(
        "star",
        tuple(rule(*r) for r in RULES),
        tuple(Fallback(n, c, tuple(range(a, b))) for n, c, a, b in FALLBACKS),
        {c: land_color(c) for c in range(COLORED) if land_color(c)},
        {c: nonland_color(c) for c in range(COLORED) if nonland_color(c)},
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


def rules_sql() -> str:
    """CTEs ``cond`` (each condition of each deck), ``hit`` (rules that hold), ``res`` (results), ``cls`` (decks classified)."""
    rules, conds = [], []
    for order, (name, with_color, conditions, variants) in enumerate(RULES):
        parent = len(rules)
        rules.append((parent, None, order, 0, name, name, with_color, len(conditions)))
        conds += [(parent, *c) for c in conditions]
        for k, (v_name, v_color, v_conditions) in enumerate(variants):
            rules.append((len(rules), parent, order, k + 1, v_name, name, v_color, len(conditions) + len(v_conditions)))
            conds += [(len(rules) - 1, *c) for c in v_conditions]
    conds = [(k, *c[:4], (c[4:] or (1,))[0]) for k, c in enumerate(conds)]
    colors = "list_transform(['W', 'U', 'B', 'R', 'G'], lambda x: CASE WHEN {} THEN x ELSE '' END)"
    from ..functions.text import COLOR_NAMES

    label = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        (CASE WHEN {c} THEN coalesce((SELECT n FROM guild WHERE k = color), '') ELSE '' END) || replace({n}, 'Generic', ''),
        '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([^A-Za-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"""
    return f"""
, rules(rule_id, parent_id, file_order, variant_order, name, parent_name, with_color, n_conditions) AS (VALUES {_values(rules)}),
conds(cond_id, rule_id, kind, lo, hi, times) AS (VALUES {_values(conds)}),
guild(k, n) AS (VALUES {_values(list(COLOR_NAMES.items()))}),
fb(fallback_id, name, with_color, lo, hi) AS (VALUES {_values([(k, *f) for k, f in enumerate(FALLBACKS)])}),
every_deck AS (SELECT DISTINCT deck_id FROM deck_cards WHERE count > 0),
seen AS (SELECT deck_id, cond_id, any_value(times) * count(*) FILTER (board = 'main') AS m, any_value(times) * count(*) FILTER (board = 'side') AS s
         FROM deck_cards JOIN conds ON card_id >= lo AND card_id < hi WHERE count > 0 GROUP BY 1, 2),
cond AS (SELECT e.deck_id, c.cond_id, c.rule_id, coalesce(m, 0) AS m, coalesce(s, 0) AS s, CASE
           WHEN lo = hi THEN true
           WHEN kind IN ('InMainboard', 'OneOrMoreInMainboard') THEN coalesce(m, 0) >= 1
           WHEN kind IN ('InSideboard', 'OneOrMoreInSideboard') THEN coalesce(s, 0) >= 1
           WHEN kind IN ('InMainOrSideboard', 'OneOrMoreInMainOrSideboard') THEN coalesce(m, 0) + coalesce(s, 0) >= 1
           WHEN kind = 'TwoOrMoreInMainboard' THEN coalesce(m, 0) >= 2
           WHEN kind = 'TwoOrMoreInSideboard' THEN coalesce(s, 0) >= 2
           WHEN kind = 'TwoOrMoreInMainOrSideboard' THEN coalesce(m, 0) + coalesce(s, 0) >= 2
           WHEN kind = 'DoesNotContain' THEN coalesce(m, 0) + coalesce(s, 0) = 0
           WHEN kind = 'DoesNotContainMainboard' THEN coalesce(m, 0) = 0
           WHEN kind = 'DoesNotContainSideboard' THEN coalesce(s, 0) = 0 END AS ok
         FROM every_deck e CROSS JOIN conds c LEFT JOIN seen USING (deck_id, cond_id)),
hit AS (SELECT deck_id, rule_id FROM cond GROUP BY 1, 2 HAVING bool_and(ok)),
res AS (SELECT h.deck_id, r.* FROM hit h JOIN rules r USING (rule_id)
        WHERE CASE WHEN r.parent_id IS NULL THEN NOT EXISTS (SELECT 1 FROM hit v JOIN rules w USING (rule_id) WHERE v.deck_id = h.deck_id AND w.parent_id = r.rule_id)
              ELSE EXISTS (SELECT 1 FROM hit p WHERE p.deck_id = h.deck_id AND p.rule_id = r.parent_id) END),
letters AS (SELECT i AS card_id, true AS land, substr('WUBRG', CAST(i % 5 AS INTEGER) + 1, 1) AS letter FROM range({COLORED}) t(i) WHERE i % 3 = 0
            UNION ALL SELECT i, false, substr('WUBRG', CAST((i // 3) % 5 AS INTEGER) + 1, 1) FROM range({COLORED}) t(i) WHERE i % 3 = 1
            UNION ALL SELECT i, false, 'G' FROM range({COLORED}) t(i) WHERE i % 3 = 1 AND i % 17 = 0 AND (i // 3) % 5 <> 4),
lit AS (SELECT deck_id, letter FROM deck_cards JOIN letters USING (card_id) WHERE count > 0 GROUP BY 1, 2 HAVING bool_or(land) AND bool_or(NOT land)),
color AS (SELECT deck_id, CASE WHEN len(ls) = 0 THEN 'C' ELSE array_to_string({colors.format("list_contains(ls, x)")}, '') END AS color
          FROM (SELECT e.deck_id, coalesce(list(letter) FILTER (letter IS NOT NULL), []) AS ls FROM every_deck e LEFT JOIN lit USING (deck_id) GROUP BY 1)),
fw AS (SELECT deck_id, fallback_id, name, with_color, hi - lo AS n_cards, sum(count) AS weight FROM deck_cards JOIN fb ON card_id >= lo AND card_id < hi
       WHERE count > 0 GROUP BY ALL),
fbest AS (SELECT deck_id, name, with_color, CAST(weight AS DOUBLE) / entries AS similarity FROM
          (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY weight DESC, n_cards, fallback_id) AS r FROM fw)
          JOIN (SELECT deck_id, count(*) AS entries FROM deck_cards WHERE count > 0 GROUP BY 1) USING (deck_id) WHERE r = 1),
lab AS (SELECT res.*, color, {label.format(c="with_color", n="res.name")} AS label FROM res JOIN color USING (deck_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY n_conditions, file_order, variant_order) AS rn,
         count(*) OVER (PARTITION BY deck_id) AS n_results,
         string_agg(label, ';') OVER (PARTITION BY deck_id ORDER BY file_order, variant_order ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS labels
         FROM lab) WHERE rn = 1),
fl AS (SELECT f.*, {label.format(c="with_color", n="f.name")} AS label FROM fbest f JOIN color USING (deck_id) WHERE similarity > 0.1),
cls AS (SELECT color.deck_id, coalesce(best.parent_name, fl.name) AS archetype, CASE WHEN best.parent_id IS NOT NULL THEN best.name END AS variant,
               coalesce(best.label, fl.label) AS label, CASE WHEN best.deck_id IS NOT NULL THEN 'rules' WHEN fl.deck_id IS NOT NULL THEN 'fallback' END AS method,
               CASE WHEN best.deck_id IS NOT NULL THEN 1.0 ELSE fl.similarity END AS similarity, color.color,
               CASE WHEN best.n_results > 1 THEN best.labels ELSE '' END AS conflict
        FROM color LEFT JOIN best USING (deck_id) LEFT JOIN fl USING (deck_id))
"""
