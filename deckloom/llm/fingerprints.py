"""Operator 12: bottom-k sketches of documents.

A text's fingerprint is the ``K`` smallest of the 64-bit hashes of its word 5-grams
(all of them where there are fewer). The fingerprint of a text in parts, or of a
set of documents, is the ``K`` smallest of their fingerprints' hashes: sketches merge
in any order, so a group of any size is merged within its tasks first. From two
fingerprints follow the resemblance of the sets (the share of the ``K`` smallest
hashes of both that are in each), from one the number of distinct n-grams, and from
both containment. Fingerprints are kept as Base64 of the hashes in order, eight
bytes each, so equal texts have equal ones.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, portions, small_batches, table, with_text
from .ngram_join import N, shingles

#: Hashes of a fingerprint. A resemblance of r is estimated with a standard error of sqrt(r (1 - r) / K).
K = 128
#: Keys that are drawn for each part of the documents' order, about; groups that a task merges at a time.
DRAWN, MERGED = 40, 20_000


def sketch(text: str | bytes | None, k: int = K, n: int = N) -> np.ndarray:
    """The k smallest hashes of the text's word n-grams, in order; with fewer than n words, that of all of them; none without words."""
    return shingles(text.encode() if isinstance(text, str) else text, n)[:k].copy()


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two sets together."""
    return np.union1d(a, b)[:k]


def written(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def read(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), dtype=">u8").astype(np.uint64)


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct n-grams of a set: exact below k, else (k - 1) / (the k-th hash as a part of all)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of two sets; of two sets without n-grams 1."""
    if not len(a) and not len(b):
        return 1.0
    both = merged(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's n-grams that b has; 1 where a has none."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def fingerprint_documents(docs: DataFrame, k: int = K, n: int = N, text_col: str = "text") -> DataFrame:
    """``docs`` with fingerprint (string) and n_shingles (double, estimated), one pass and no shuffle.

    A missing text is an empty one; texts without words have an empty fingerprint. Input
    columns of these two names are replaced, all others pass; repeated rows stay, and an
    empty table is empty.
    """
    added = ["fingerprint", "n_shingles"]
    rows, own, at = with_text(docs, text_col, added)
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.select(*own).schema), T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, at):
                found = [sketch(x.as_py(), k, n) for x in batch.column(at)]
                cols = [pa.array([written(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *cols], [*own, *added])

    return rows.mapInArrow(run, schema)


def merge_fingerprints(rows: DataFrame, key: str, k: int = K, fingerprint_col: str = "fingerprint") -> DataFrame:
    """(key, fingerprint, n_shingles): the fingerprint of each group's texts together.

    Tasks merge what they hold of a group before anything is shuffled, so a group
    arrives as about one row from each task, and those are merged one after the other.
    A missing key is a group of its own, a missing fingerprint has no hashes; an empty
    table gives no groups.
    """
    kind = rows.schema[key].dataType
    name, print_ = fresh("fingerprint", [key]), fresh("n_shingles", [key])
    given = rows.select(F.col(key), F.col(fingerprint_col).alias(name))
    partial = T.StructType([T.StructField(key, kind), T.StructField(name, T.StringType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), types[0]), pa.array([written(x) for x in held.values()], pa.string())], [key, name])
            held.clear()
            return batch

        types = [pa.null()]
        for batch in batches:
            types = [batch.schema.field(0).type]
            for group, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[group] = merged(held[group], read(x), k) if group in held else read(x)[:k]
                if len(held) >= MERGED:
                    yield out()
        if held:
            yield out()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for batch in batches:
            kind_ = batch.schema.field(0).type
            done: list[tuple] = []
            for group, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None and group == last:
                    now = merged(now, read(x), k)
                    continue
                if now is not None:
                    done.append((last, now))
                last, now = group, read(x)
            if done:
                yield packed(done, kind_)
        if now is not None:
            yield packed([(last, now)], kind_)

    def packed(done: list[tuple], kind_: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([x[0] for x in done], kind_), pa.array([written(x[1]) for x in done], pa.string()), pa.array([distinct(x[1], k) for x in done], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, [key, name, print_])

    parts = given.mapInArrow(within, partial)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    final = T.StructType([*partial.fields, T.StructField(print_, T.DoubleType())])
    return parts.repartition(n, key).sortWithinPartitions(key).mapInArrow(across, final)


def compare_fingerprints(rows: DataFrame, left: str, right: str, k: int = K) -> DataFrame:
    """``rows`` with resemblance, contained (the share of left's n-grams that right has) and contains (the other way round), from two fingerprint columns.

    Input columns of these names are replaced; a missing fingerprint has no hashes.
    """
    kind = "resemblance double, contained double, contains double"

    @F.pandas_udf(kind)
    def judged(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = [(read(x), read(y)) for x, y in zip(a, b)]
        return pd.DataFrame({"resemblance": [resemblance(x, y, k) for x, y in pairs], "contained": [containment(x, y, k) for x, y in pairs], "contains": [containment(y, x, k) for x, y in pairs]}, dtype="float64")

    names = ["resemblance", "contained", "contains"]
    made = fresh("judged", rows.columns)
    own = [c for c in rows.columns if c.lower() not in names]
    return rows.withColumn(made, judged(F.col(left), F.col(right))).select(*own, *[F.col(f"{made}.{c}").alias(c) for c in names])


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, head, id, text): documents in parts of descending ids, each part sorted and within one partition.

    The last row of a part (head = 1) is a copy of the next part's first one, after the last part of the
    first one's, so every document finds the one after it within its part. Parts begin at keys of
    real documents, which are drawn; the driver sees about ``DRAWN`` keys for each partition. Texts are shuffled once.
    Rows without an id come last, rows of one id in an order of their texts.
    """
    spark = docs.sparkSession
    key = [F.col("id").isNull().cast("int").alias("gone"), F.bitwise_not(F.coalesce("id", F.lit(0).cast("long"))).alias("place"), F.xxhash64("text").alias("th")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(*key, "id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("gone", "place", "th")
    least = keys.agg(F.min(F.struct("gone", "place", "th")).alias("k"), F.count("*").alias("n")).first()
    if not least["n"]:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("head"), "id", "text")
    drawn = keys.sample(min(1.0, n * DRAWN / least["n"]), 7).collect()
    drawn = sorted({tuple(r) for r in drawn} | {tuple(least["k"])})
    bounds = sorted({drawn[0], *(drawn[len(drawn) * k // n] for k in range(n))})

    @F.pandas_udf("int")
    def part(gone: pd.Series, place: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) - 1 for x in zip(gone.tolist(), place.tolist(), th.tolist())], dtype="int32")

    first = spark.createDataFrame([(*b, (k - 1) % len(bounds)) for k, b in enumerate(bounds)], "gone int, place long, th long, part int")
    heads = rows.join(F.broadcast(first), ["gone", "place", "th"]).dropDuplicates(["part"])  # one row for each partition
    every = rows.withColumn("part", part("gone", "place", "th")).withColumn("head", F.lit(0)).unionByName(heads.withColumn("head", F.lit(1)))
    return every.repartitionById(n, F.col("part")).sortWithinPartitions("part", "head", "gone", "place", "th").select("part", "head", "id", "text")


def fingerprint_edits(docs: DataFrame, k: int = K, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints tell a document from its edited text and from the next document.

    The edited text: the last half of the code points (rounded down) is replaced by as many of the first ones of the
    next document (or all of its), in descending order of ids; after the last comes the first.

    Returns for each row: the id (long), n_chars (long, code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (double, estimated resemblance to the edited text and to the next
    document), n_shingles and kept (double, estimated: distinct n-grams, and the share of them that the edited text has).

    A missing text is an empty one. Rows without an id come last, rows of one id in an order of their
    texts; a single row is its own next one. Texts are taken whole; a task holds two rows at a time besides its
    batch. An empty table is empty; other columns do not pass.
    """
    small_batches(docs.sparkSession)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def judged(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = f"{text[: len(text) - half]}{following[:half]}".encode()
        new = sketch(edited, k, n)
        return len(text), hashlib.sha256(edited).hexdigest(), written(own), written(new), resemblance(own, new, k), resemblance(own, theirs, k), distinct(own, k), containment(own, new, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for batch in portions(whole, 2):
                out = []
                for head, id_, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    text = text or ""
                    now = (head, id_, text, sketch(text, k, n))
                    if before is not None and not before[0]:
                        out.append((before[1], *judged(before[2], before[3], text, now[3])))
                    before = now
                cols = list(zip(*out)) or [()] * (len(names) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *kinds])], [id_col, *names])

    schema = T.StructType([T.StructField(id_col, T.LongType()), *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept double").fields])
    return in_order(docs, id_col, text_col).select("head", "id", "text").mapInArrow(run, schema)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
