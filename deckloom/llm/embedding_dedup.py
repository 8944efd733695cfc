"""Operator 6: near-duplicate embeddings by cross-polytope hashing.

Each of ``tables`` hash tables rotates a vector ``per_table`` times by three rounds
of random signs and a fast Walsh-Hadamard transform; the axis nearest to the
rotated vector (2 x dimension choices) is one part of the bucket. A vector also
goes into the buckets where one part is replaced by its second nearest axis, so
that two vectors meet if either's probes hit. Buckets are cut into cells of
bounded size; in a cell all pairs are compared in double precision.

Equal vectors are collapsed first. A pair that meets in several buckets counts in
the least of them. Cells return sums and a spanning forest, a few values for
each member, never their pairs.

The angle is a metric, so vectors within half the threshold's angle of one direction
are linked with each other for certain. Where a bucket is too large for one cell,
the mean of some of its vectors is taken for such a direction; those in that ball are
counted as a group and need not meet anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_cell, cells, components, cut, first_shared, numbered, padded, pairs_within, roots, table, whole_cells

TABLES, PER_TABLE, BLOCK = 10, 3, 1024
#: Cells of fewer members are compared pair by pair, many cells at a time; pairs worked on at a time; vectors that a ball's middle is made from, about.
SMALL, PAIRS, SAMPLE = 48, 1 << 16, 64
#: How much closer to its middle than it needs to be a vector of a ball has to be, for the rounding of cosines.
MARGIN = 1e-9


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x (width a power of two) after rounds of random signs and a Hadamard transform."""
    for s in signs:
        x = x * s
        width = 1
        while width < x.shape[1]:
            y = x.reshape(len(x), -1, 2, width)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), -1)
            width *= 2
        x = x / np.sqrt(np.float32(x.shape[1]))
    return x


def buckets(x: np.ndarray, tables: int = TABLES, per_table: int = PER_TABLE, seed: int = 11) -> np.ndarray:
    """(rows, tables x (1 + per_table)) bucket numbers of unit vectors, the home bucket of a table first."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width), dtype=np.float32)
    padded[:, :d] = x
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, tables, 1 + per_table), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        parts = []
        for _ in range(per_table):
            r = rotate(padded, rng.choice([-1.0, 1.0], (3, width)).astype(np.float32))
            near = np.argpartition(-np.abs(r), 1, axis=1)[:, :2]
            order = np.argsort(-np.abs(np.take_along_axis(r, near, 1)), axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            axis = near + width * (r[rows[:, None], near] < 0)
            parts.append(axis.astype(np.int64))
        for probe in range(1 + per_table):
            key = np.full(n, (t + 1) * 1_000_003 + d, dtype=np.int64)
            for p, axis in enumerate(parts):
                key = key * (2 * width) + axis[:, 1 if probe == p + 1 else 0]
            out[:, t, probe] = key
    return out.reshape(n, -1)


def _unit(flat: np.ndarray, d: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, d)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(lists: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Unit rows of vectors of one length."""
    some = lists.combine_chunks().take(pa.array(rows))
    return _unit(some.flatten().to_numpy(), len(some[0]))


def _candidates(t: pa.Table, edges: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell that are near enough."""
    lengths = t["v"].combine_chunks().value_lengths().to_numpy()
    for d in np.unique(lengths):  # vectors of other lengths never share a bucket
        rows = np.flatnonzero(lengths == d)
        x = _vectors(t["v"], rows)
        at = np.searchsorted(rows, edges)
        sizes = np.diff(at)
        small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
        if len(small):
            inside = np.concatenate([np.arange(at[k], at[k + 1]) for k in small])
            a, b = pairs_within(np.concatenate([[0], np.cumsum(sizes[small])]))
            for i in range(0, len(a), PAIRS):
                p, q = inside[a[i : i + PAIRS]], inside[b[i : i + PAIRS]]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                yield rows[p[near]], rows[q[near]]
        for k in np.flatnonzero(sizes > SMALL):
            y = x[at[k] : at[k + 1]]
            for i in range(0, len(y), 256):
                p, q = np.nonzero(y[i : i + 256] @ y.T >= threshold)
                p = p + i
                yield rows[at[k] + p[p < q]], rows[at[k] + q[p < q]]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_cells(batches, ["k", "p", "q"]):
            ids, k, chunk, copies = (t[c].to_numpy() for c in ("id", "k", "chunk", "copies"))
            across = t["p"].to_numpy() != t["q"].to_numpy()
            keys = t["keys"].combine_chunks()
            left, right = padded(keys, -1), padded(keys, -2)
            ball = numbered(t["ball"])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in _candidates(t, edges, threshold):
                ok = (ids[a] != ids[b]) & ((chunk[a] != chunk[b]) | ~across[a]) & ((ball[a] != ball[b]) | (ball[a] < 0))
                a, b = a[ok], b[ok]
                for i in range(0, len(a), PAIRS):
                    p, q = a[i : i + PAIRS], b[i : i + PAIRS]
                    first = first_shared(left[p], right[q]) == k[p]
                    found.append((p[first], q[first]))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            names, at = np.unique(ids, return_inverse=True)
            links = np.bincount(at[a], copies[b], len(names)) + np.bincount(at[b], copies[a], len(names))
            root = names[roots(len(names), at[a], at[b])]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["id", "links", "root"]
            )

    return run


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The direction of the mean of some vectors of one length."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
    mean = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).mean(axis=0)
    return pd.DataFrame({"home": pdf["home"].iloc[:1], "middle": [mean]})


def _inside(threshold: float):
    """Of (id, home, v, middle) those within half the threshold's angle of the middle."""
    least = np.sqrt((1 + threshold) / 2) + MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (v, middle) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.asarray(c.values.to_numpy(zero_copy_only=False), dtype=np.float64) for c in (v, middle))
                size = np.sqrt((x @ x) * (y @ y))
                if size and (x @ y) / size >= least:
                    keep.append(k)
            yield batch.select(["id", "home"]).take(pa.array(keep, pa.int64()))

    return run


def balls(members: DataFrame, base: DataFrame, threshold: float, block: int) -> DataFrame | None:
    """(id, ball, copies) of vectors that are all linked with those of the same ball; None if no bucket is large.

    Each vector is tried with the middle of the largest bucket that it is in.
    """
    sizes = cut(members.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > block))
    if sizes.isEmpty():
        return None
    home = members.join(sizes, "k").groupBy("id").agg(F.max(F.struct("m", "k")).alias("h")).select("id", F.col("h.k").alias("home"))
    tried = cut(home.join(base.select("id", "v"), "id"))
    counts = cut(tried.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE))
    some = F.pmod(F.xxhash64(F.lit(11), "id"), F.ceil(F.col("n") / F.lit(SAMPLE))) == 0
    sampled = tried.join(counts, "home").where(some).select("home", "v")
    middles = cut(sampled.groupBy("home").applyInPandas(_middle, "home long, middle array<double>"))
    near = tried.join(middles, "home").select("id", "home", "v", "middle")
    inside = near.mapInArrow(_inside(threshold), "id long, home long")
    return cut(inside.select("id", F.col("home").alias("ball")).join(base.select("id", "copies"), "id"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    per_table: int = PER_TABLE,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows are linked if they are found and their cosine is ``threshold`` or more;
    equal vectors always are. Vectors that are missing, zero or hold missing or
    non-finite components link with nothing, nor do vectors of different lengths. Of
    ids that repeat each row gets the links of its own vector; the component joins them.
    A missing id is replaced by a negative one made from the vector.
    Other columns are not looked at; an empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    good = F.coalesce(
        (F.size(v) > 0)
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists(v, lambda e: e != 0),
        F.lit(False),
    )
    # Adding zero makes -0.0 equal to 0.0.
    clean = F.transform(v, lambda e: e + F.lit(0.0).cast(kind[6:-1]))
    own = F.md5(F.concat_ws(",", F.transform(clean, lambda e: e.cast("string"))))
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62)) - F.pmod(F.xxhash64(own), F.lit(2**61))).alias("id"),
        F.col(id_col).alias("_own"),
        F.when(good, own).alias("h"),
        F.when(good, clean).alias("v"),
    )
    classes = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            keys: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                flat = lists.take(pa.array(at)).flatten().to_numpy()
                for i, k in zip(at, buckets(_unit(flat, int(d)), tables, per_table)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["id", "copies", "v", "keys"])

    base = cut(classes.select("rep", "copies", "v").mapInArrow(hashed, f"id long, copies long, v {kind}, keys array<long>"))
    members = base.select("id", F.explode(F.array_distinct("keys")).alias("k"))
    ball = balls(members, base, threshold, block)
    members = members.withColumn("ball", F.lit(None).cast("long")) if ball is None else members.join(ball.select("id", "ball"), "id", "left")
    placed = cut(cells(members, "k", "id", block, alike=None if ball is None else "ball").select("cell", "chunk", "id", "ball"))
    # Only buckets that a vector shares are asked which is the first.
    shared = placed.groupBy("id").agg(F.array_sort(F.collect_set("cell.k")).alias("keys"))
    found = cut(
        by_cell(placed.join(base.select("id", "copies", "v").join(shared, "id"), "id")).mapInArrow(_compare(threshold), "id long, links long, root long")
    )
    if ball is not None:
        whole = ball.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("id").alias("root"))
        found = found.unionByName(ball.join(cut(whole), "ball").select("id", (F.col("all") - F.col("copies")).alias("links"), "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    comp = components(edges).select(F.col("node").alias("id"), "component")
    per_class = (
        classes.select("h", "rep", "copies")
        .join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "id")
    return rows.select("id", "_own", "h").join(per_class, "h", "left").select(
        F.col("_own").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL: dict[str, str] = {
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
}
