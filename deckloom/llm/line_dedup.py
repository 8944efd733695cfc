"""Operator 2: deletes later copies of repeated runs of lines.

The non-blank lines of a document are a sequence of line ids. Two suffixes of
such sequences are in one class at depth h if their first h lines agree; these
classes are the intervals of the suffix array whose longest common prefix is h
or more. Prefix doubling takes them from depth h to 2h: a suffix's class at 2h is
the pair of its class at h and that of the suffix h lines further on. A class is
named by its first suffix in document order, so a suffix with another name than
itself starts a later copy of a run of h lines. Suffixes alone in their class
have no repeat of that depth and leave, so the table shrinks with every round.

The lines of a maximal repeated run of L lines (2^t <= L) are those of the
windows of 2^t lines at its start and its end, both of which are later copies at
depth 2^t; so the deleted lines follow from the doubling classes alone. Lengths
below ``min_words`` that are no power of two take two overlapping windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, cut, table

KEY = ["d", "t"]


def _flat(line: Column) -> Column:
    """The line with each run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(line, r"[ \t\f\r\x0B]+", " "))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, i, at, w, line): non-blank lines with their place among those (i), among all (at), and their words."""
    parts = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), lambda x, k: F.struct(k.alias("at"), x.alias("line"))),
        lambda x: _flat(x["line"]) != "",
    )
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"),
        F.xxhash64(F.col(text_col)).alias("t"),
        F.posexplode(parts).alias("i", "x"),
    )
    n = F.size(F.split(_flat(F.col("x.line")), " "))
    return keyed.select("d", "t", "i", F.col("x.at").alias("at"), n.alias("w"), F.unhex(F.md5("x.line")).alias("line"))


def _pos():
    return F.struct("d", "t", "i")


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``by`` also occurs elsewhere, with the first such place as ``name``.

    The names are written before the join, so that both its sides are plain shuffles
    and Spark can split the partition of a very frequent class.
    """
    found = rows.groupBy(*by).agg(F.min(_pos()).alias("name"), F.max(_pos()).alias("_last"))
    return rows.join(cut(found.where("name <> _last").drop("_last")), by)


def _step(rows: DataFrame, ahead: int) -> DataFrame:
    """From depth h to h + ahead (ahead <= h); rows: (d, t, i, at, name, c, e)."""
    there = W.partitionBy(*KEY).orderBy("i").rangeBetween(ahead, ahead)
    paired = rows.select(
        *KEY, "i", "at", "c",
        F.col("name").alias("a"),
        F.max("name").over(there).alias("b"),
        F.max("e").over(there).alias("e"),
    ).where("b is not null")
    return _classes(paired, ["a", "b"]).select(*KEY, "i", "at", "name", "c", "e")


def _levels(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[int, DataFrame]]:
    """(h, rows) for h = 1, 2, 4 ...: (d, t, i, at, name, c, e) of all suffixes whose first h lines have a copy, until there is none.

    c: words before the line, e: words up to the end of its window, both counted over the repeated lines.
    """
    first = _classes(_lines(docs, id_col, text_col), ["line"]).select(*KEY, "i", "at", "w", "name").distinct()
    upto = F.sum("w").over(W.partitionBy(*KEY).orderBy("i"))
    rows, h, out = cut(first.select(*KEY, "i", "at", "name", (upto - F.col("w")).alias("c"), upto.alias("e"))), 1, []
    while not rows.isEmpty():
        out.append((h, rows))
        rows, h = cut(_step(rows, h)), 2 * h
    return out or [(1, rows)]


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5
) -> DataFrame:
    """(d, t, i, at): the lines that lie in a later copy of a run of min_words words or more."""
    levels, marks = _levels(docs, id_col, text_col), []
    places = levels[0][1].select(*KEY, "i", "at")

    def mark(found: DataFrame, length: int) -> DataFrame:
        later = found.where((F.col("name") != _pos()) & (F.col("e") - F.col("c") >= min_words))
        return later.select(*KEY, "i", (F.col("i") + length).alias("end"))

    for h, rows in levels:
        marks.append(mark(rows, h))
        marks += [mark(_step(rows, k - h), k) for k in range(h + 1, min(2 * h - 1, min_words) + 1)]
    covered = marks[0]
    for m in marks[1:]:
        covered = covered.unionByName(m)
    covered = covered.groupBy(*KEY, "i").agg(F.max("end").alias("end"))
    reach = F.max("end").over(W.partitionBy(*KEY).orderBy("i"))
    return (
        places.join(covered, [*KEY, "i"], "left").withColumn("reach", reach).where("reach > i").select(*KEY, "i", "at")
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, i, lines, first, copies): the runs of lines that repeat an earlier one, and how far they agree with it.

    For every suffix its deepest class is taken; ``first`` (d, t, i) is the class's first
    place and ``copies`` its size. Their longest common prefix, ``lines``, is found from
    the classes again, by halves: where both go on alike for half as many lines they move
    on by those. A run that only goes on with the same run one line further up is left out.
    d is the document's id and t its text's hash; i counts non-blank lines.
    """
    levels = _levels(docs, id_col, text_col)
    deepest = None
    for h, rows in levels:
        sizes = cut(rows.groupBy("name").agg(F.count("*").alias("copies")))
        later = rows.join(sizes, "name").where(F.col("name") != _pos()).select(*KEY, "i", F.struct(F.lit(h).alias("h"), "name", "copies").alias("x"))
        deepest = later if deepest is None else deepest.unionByName(later)
    found = deepest.groupBy(*KEY, "i").agg(F.max("x").alias("x"))
    found = cut(found.select(*KEY, "i", F.col("x.h").alias("h"), F.col("x.h").alias("lines"), F.col("x.name").alias("first"), "x.copies"))
    for h, rows in reversed(levels[:-1]):
        mine = rows.select(*KEY, F.col("i").alias("_at"), F.col("name").alias("_mine"))
        other = rows.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("i").alias("_first"), F.col("name").alias("_other"))
        here = found.withColumn("_at", F.col("i") + F.col("lines")).withColumn("_first", F.col("first.i") + F.col("lines"))
        both = here.withColumn("_d", F.col("first.d")).withColumn("_t", F.col("first.t")).join(mine, [*KEY, "_at"], "left").join(other, ["_d", "_t", "_first"], "left")
        on = F.coalesce((F.col("h") > h) & (F.col("_mine") == F.col("_other")), F.lit(False))
        found = cut(both.select(*KEY, "i", "h", (F.col("lines") + F.when(on, h).otherwise(0)).alias("lines"), "first", "copies"))
    order = W.partitionBy(*KEY).orderBy("i")
    above = F.struct(F.col("first.d").alias("d"), F.col("first.t").alias("t"), (F.col("first.i") - 1).alias("i"))
    inner = (F.lag("i").over(order) == F.col("i") - 1) & (F.lag("first").over(order) == above)
    return found.withColumn("_inner", F.coalesce(inner, F.lit(False))).where("not _inner").select(*KEY, "i", "lines", "first", "copies")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5
) -> DataFrame:
    """``docs`` with the text less its deleted lines, and n_lines, n_deleted, n_runs.

    A line goes if it belongs to consecutive non-blank lines of min_words
    whitespace-separated words or more that also stand at an earlier place: in a
    document of a smaller id, or further up in the same one. The first copy
    stays; so do blank lines, and shorter coincidences. Lines are equal if all
    their characters are.

    A missing text stays missing and has no lines; an empty one has one blank
    line. Rows that repeat both id and text count as one place, so none of them
    loses lines to the other. Missing ids come first. Input columns named n_lines,
    n_deleted or n_runs are replaced; all others pass.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    new_run = F.when(F.lag("i").over(W.partitionBy(*KEY).orderBy("i")) == F.col("i") - 1, 0).otherwise(1)
    per_doc = (
        gone.withColumn("_run", new_run)
        .groupBy(F.col("d").alias("_d"), F.col("t").alias("_t"))
        .agg(F.collect_set("at").alias("_gone"), F.sum("_run").cast("int").alias("_runs"))
    )
    given = docs.drop("n_lines", "n_deleted", "n_runs")
    own, meanwhile = aside(given, ["_d", "_t", "_gone", "_runs", "_lines"])
    keyed = own.withColumn("_d", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn("_t", F.xxhash64(F.col(text_col)))
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(stay, lambda k: F.col("_lines")[k]), "\n")
    )
    return (
        keyed.join(per_doc, ["_d", "_t"], "left")
        .withColumn("_lines", lines)
        .select(
            *[text.alias(c) if c == text_col else F.col(meanwhile.get(c, c)).alias(c) for c in given.columns],
            F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).alias("n_deleted"),
            F.coalesce("_runs", F.lit(0)).alias("n_runs"),
        )
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)


#: Every line of a run of five words or more lies in a run of at most five lines that has five words.
SQL = {
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l WHERE text IS NOT NULL),
f AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '[ \t\f\r\x0B]+', ' ', 'g'), ' ') AS flat FROM x),
o AS (SELECT doc_id, pos, md5(line) AS line, len(string_split(flat, ' ')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
      FROM f WHERE flat <> ''),
w AS (
  SELECT doc_id, i, k, c, d FROM (
    SELECT doc_id, i, k, count(*) OVER g AS n, sum(w) OVER g AS c, md5(string_agg(line, ',') OVER g) AS d
    FROM o, (SELECT 1 AS k) WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND CURRENT ROW)) WHERE n = k
  UNION ALL SELECT doc_id, i, k, c, d FROM (
    SELECT doc_id, i, k, count(*) OVER g AS n, sum(w) OVER g AS c, md5(string_agg(line, ',') OVER g) AS d
    FROM o, (SELECT 2 AS k) WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE n = k
  UNION ALL SELECT doc_id, i, k, c, d FROM (
    SELECT doc_id, i, k, count(*) OVER g AS n, sum(w) OVER g AS c, md5(string_agg(line, ',') OVER g) AS d
    FROM o, (SELECT 3 AS k) WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = k
  UNION ALL SELECT doc_id, i, k, c, d FROM (
    SELECT doc_id, i, k, count(*) OVER g AS n, sum(w) OVER g AS c, md5(string_agg(line, ',') OVER g) AS d
    FROM o, (SELECT 4 AS k) WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = k
  UNION ALL SELECT doc_id, i, k, c, d FROM (
    SELECT doc_id, i, k, count(*) OVER g AS n, sum(w) OVER g AS c, md5(string_agg(line, ',') OVER g) AS d
    FROM o, (SELECT 5 AS k) WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = k),
later AS (SELECT doc_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY doc_id, i) AS r FROM w WHERE c >= 5) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM later),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before <> i - 1) AS runs
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
stay AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.pos) AS text
         FROM x LEFT JOIN (SELECT o.doc_id, o.pos FROM o JOIN gone USING (doc_id, i)) g ON x.doc_id = g.doc_id AND x.pos = g.pos
         WHERE g.pos IS NULL GROUP BY x.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(stay.text, '') END AS text,
       CAST(CASE WHEN l.text IS NULL THEN 0 ELSE len(l.ls) END AS INTEGER) AS n_lines,
       CAST(coalesce(runs.n, 0) AS INTEGER) AS n_deleted, CAST(coalesce(runs.runs, 0) AS INTEGER) AS n_runs
FROM l LEFT JOIN runs USING (doc_id) LEFT JOIN stay USING (doc_id)
"""
}
