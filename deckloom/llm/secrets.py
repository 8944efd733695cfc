"""Operator 5: finds secrets, scanning every distinct text once for each rule version.

A ledger of (blob, rule, version, spans) on disk remembers what was scanned, also by
earlier sessions. A blob is the SHA-256 of a text, so every version of a document has
one and copies share it. Only blobs that the ledger lacks for a rule at its present
version are scanned; the findings are appended and joined back to all rows that hold
the blob: all paths, and all versions of each. Spans are counted in code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import committed, cut, fresh, shared_dir, table

SPANS = "array<struct<start:int,end:int>>"
#: Matches whose places are summed up one after the other.
RUN = 128


@dataclass(frozen=True)
class Rule:
    """A pattern of Java's and RE2's common syntax; matches count if ``group`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: The kinds of the contract, in its order.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)


def _quick(rule: Rule) -> str:
    """A pattern that finds something wherever a match counts."""
    if rule.group == 0 and rule.pattern.endswith("+"):
        return f"{rule.pattern[:-1]}{{{_quantity(rule)},}}"
    return rule.pattern


def _quantity(rule: Rule) -> int:
    return rule.least - len(rule.pattern.partition("[")[0])


def spans(text: Column, rule: Rule) -> Column:
    """Start and end of the matches that count, in order.

    The parts between matches and the matches alternate, so the running sum of
    their lengths gives the places. A greedy run that is too short hides no
    longer one, so for patterns that are a single run the quick pattern has the
    same matches that count.
    """
    pattern, group = (_quick(rule), 0) if rule.group == 0 else (rule.pattern, rule.group)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    matches = F.zip_with(
        F.zip_with(between, whole, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"))),
        inner,
        lambda a, b: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), F.length(b).alias("inner")),
    )
    found = _let(matches, lambda all_: F.filter(F.zip_with(_starts(F.transform(all_, lambda m: m["gap"] + F.coalesce(m["n"], F.lit(0)))), all_, _span), lambda m: m["inner"] >= rule.least))
    kept = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(_quick(rule)), kept).otherwise(F.array().cast(SPANS))


def _span(at: Column, m: Column) -> Column:
    begin = at + m["gap"]
    return F.struct(begin.alias("start"), (begin + F.coalesce(m["n"], F.lit(0))).alias("end"), m["inner"].alias("inner"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x being worked out once."""
    return F.transform(F.array(x), f)[0]


def _starts(sizes: Column, levels: int = 2) -> Column:
    """The sum of the sizes before each one. Only arrays of up to ``RUN`` sizes grow one by one, so the work is linear in the number of sizes up to RUN ** (levels + 1)."""

    def within(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        grown = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(run, start, grown, lambda acc: acc["out"])

    if not levels:
        return within(sizes, F.lit(0))

    def over(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(runs, _starts(totals, levels - 1), within))

    def parted(all_: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int"))
        return _let(F.transform(places, lambda k: F.slice(all_, k * RUN + 1, F.lit(RUN))), over)

    return _let(sizes, parted)


class SecretLedger:
    """A folder of parquet files (blob binary, rule string, version int, spans), one batch for each scan.

    The batches are found in the folder, so a ledger that is opened again, by another
    session too, knows what was scanned before. A batch that a failed run left unfinished
    is not seen, since Spark marks a table when all its files are there; a blob that was
    scanned twice, say by two sessions at once, has equal rows and is read once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def known(self) -> DataFrame | None:
        batches = committed(self.spark, self.path)
        if not batches:
            return None
        rows = self.spark.read.schema(f"blob binary, rule string, version int, spans {SPANS}").parquet(*batches)
        return rows.dropDuplicates(["blob", "rule", "version"])

    def scan(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans unseen (blob, rule, version) triples of the texts; returns those findings that it added."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = docs.select(blob(text_col).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        known = self.known()
        if known is None:
            blobs = blobs.withColumn("done", F.array().cast("array<string>"))
        else:
            now = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
            mark = F.concat_ws("@", "rule", "version")
            done = known.where(F.array_contains(now, mark)).groupBy("blob").agg(F.collect_set(mark).alias("done"))
            blobs = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
            blobs = blobs.where(F.size("done") < len(rules))
        found = [
            F.when(
                ~F.array_contains("done", f"{r.name}@{r.version}"),
                F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")),
            )
            for r in rules
        ]
        rows = blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.*")
        path = f"{self.path}/batch-{len(committed(self.spark, self.path)):05d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def findings(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``docs`` with one array column of spans for each rule, after scanning what is unseen.

        A missing text counts as empty and has no spans; copies and rows that
        repeat share one scan; the length of a text is not limited. Input columns
        named like a rule are replaced.
        """
        self.scan(docs, text_col, rules)
        hits = self.known().where(F.size("spans") > 0)
        per_rule = [
            F.max(F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.col("spans"))).alias(r.name) for r in rules
        ]
        own = docs.drop(*[r.name for r in rules])
        key = fresh("blob", own.columns)
        # Written before the join, so that both its sides are plain shuffles and Spark can split a very frequent text.
        per_blob = cut(hits.groupBy(F.col("blob").alias(key)).agg(*per_rule))
        joined = own.withColumn(key, blob(text_col)).join(per_blob, key, "left")
        return joined.select(*own.columns, *[F.coalesce(r.name, F.array().cast(SPANS)).alias(r.name) for r in rules])

    def exposures(
        self, history: DataFrame, path_col: str = "path", version_col: str = "version", text_col: str = "text", rules: tuple[Rule, ...] = RULES
    ) -> DataFrame:
        """(path, rule, secret_sha256, first_version, last_version, versions): where each secret stands or stood.

        history: a row for each version of each path, old ones too. A secret is known by
        the hash of its match, which says nothing of the secret itself. A missing path or
        version is one as any other.
        """
        keyed = history.select(F.col(path_col).alias("path"), F.col(version_col).alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        tagged = [F.transform(r.name, lambda s, n=r.name: F.struct(F.lit(n).alias("rule"), s.alias("s"))) for r in rules]
        found = self.findings(keyed, "text", rules).select("path", "version", "text", F.explode(F.concat(*tagged)).alias("x"))
        match = F.substring(F.col("text"), F.col("x.s.start") + 1, F.col("x.s.end") - F.col("x.s.start"))
        found = found.select("path", "version", F.col("x.rule").alias("rule"), F.sha2(match, 256).alias("secret_sha256"))
        return found.groupBy("path", "rule", "secret_sha256").agg(
            F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.count_distinct("version").alias("versions")
        )


def blob(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def digest_spans(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all kinds by start, then by the kinds' order, comma-joined."""
    def tag(n: int, kind: str) -> Column:
        line = lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), line(s).alias("s")))

    tagged = [tag(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: x["s"]), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A folder of one's own keeps what was scanned from run to run.
    given = spark.conf.get("deckloom.secrets.ledger", None)
    ledger = SecretLedger(spark, given or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    kinds = tuple(r.name for r in RULES)
    found = ledger.findings(docs).select("doc_id", *kinds, digest_spans(kinds).alias("spans"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


def _sql_kind(kind: str, pattern: str, keep: str, order: int) -> str:
    """Matches of a kind: the text between two matches is what regexp_split_to_array leaves."""
    p = pattern.replace("'", "''")
    return f"""
SELECT r, '{kind}' AS kind, {order} AS k, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY n) - length(m) AS a,
       sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY n) AS b, {keep} AS ok
FROM (SELECT r, unnest(range(1, len(ms) + 1)) AS n, unnest(ms) AS m, unnest(inn) AS i, unnest(gaps[1:len(ms)]) AS gap
      FROM (SELECT r, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0}) AS inn,
                   regexp_split_to_array(text, '{p}') AS gaps FROM d))"""


SQL = {
    "op5_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_sql_kind('assign', RULES[0].pattern, 'length(i) >= 12', 0)}
UNION ALL {_sql_kind('access', RULES[1].pattern, 'length(m) >= 18', 1)}
UNION ALL {_sql_kind('hex', RULES[2].pattern, 'length(m) >= 16', 2)}),
s AS (SELECT r, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh,
             string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans
      FROM m WHERE ok GROUP BY r)
SELECT doc_id, CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nk, 0) AS BIGINT) AS n_access, CAST(coalesce(nh, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)
"""
}
