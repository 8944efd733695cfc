"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text: A-Z become a-z, the other ASCII bytes outside 0-9a-z become
#: blanks, bytes of non-ASCII characters stay. ``split()`` then yields the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for a missing text."""
    return text.translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session, as in tests, gets a temporary folder; on a
    cluster, whose executors could not see it, that raises RuntimeError.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="deckloom-"))
    return context.getCheckpointDir()


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The tables below a folder, in order, whose writing was finished."""
    files, at = _files(spark, folder)
    if not files.exists(at):
        return []
    found = sorted(x.getPath().toString() for x in files.listStatus(at) if x.isDirectory())
    return [x for x in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this library made and no longer needs."""
    files, at = _files(spark, folder)
    files.delete(at, True)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names under others, and what each is called meanwhile."""
    meanwhile: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            meanwhile[c] = fresh(f"own_{c}", [*docs.columns, *names, *meanwhile.values()])
    return docs.select(*[F.col(f"`{c}`").alias(meanwhile.get(c, c)) for c in docs.columns]), meanwhile


def back(found: DataFrame, docs: DataFrame, meanwhile: dict[str, str], **new: Column) -> DataFrame:
    """The columns of ``docs`` under their own names, those in ``new`` with new values."""
    return found.select(*[(new[c] if c in new else F.col(f"`{meanwhile.get(c, c)}`")).alias(c) for c in docs.columns])


#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_ROWS``: JVM and Python hold several batches of texts at once, which may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def with_text(docs: DataFrame, text_col: str, replaced: list[str]) -> tuple[DataFrame, list[str], int]:
    """For a pass in Python: the columns that stay and, if it is not among them, the text; their names; the text's place."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in {r.lower() for r in replaced}]
    if text_col in own:
        return docs.select(*own), own, own.index(text_col)
    return docs.select(*own, F.col(text_col)), own, len(own)


def portions(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows whose texts have ``size`` bytes together; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(a, b - a)
        a = b
    pa.default_memory_pool().release_unused()


def sent(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """The rows marked for broadcast if their number was counted and they are ``most`` bytes or less; else as they are."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that their lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cells(members: DataFrame, key: str, member: str, block: int, weight: str | None = None, heavy: int = 1, alike: str | None = None) -> DataFrame:
    """Blocks of pairs: every two members of a key meet in just one cell.

    A key of m members is dealt into about m / block chunks by a hash of the
    member, or into more, so that the column ``weight`` adds up to about ``heavy``
    in each; each two chunks are a cell, so no task sees a whole large key.
    Keys of a single member go. Adds ``cell`` (key and the two chunks) and
    ``chunk`` (the member's own).

    alike: a column; two members with one value there that is not null need not meet.
    The largest group of such members in a key of more than ``block`` is dealt into
    chunks of its own, which meet those of all others but not each other. So members
    of which all but a few are alike are written a few times each, however many.
    """
    mass = F.sum(weight) if weight else F.lit(0)
    sizes = members.groupBy(key).agg(F.count("*").alias("_m"), mass.alias("_w"))
    chunks = lambda m, w: F.greatest(F.ceil(m / F.lit(block)), F.ceil(w / F.lit(heavy))).cast("int")
    if alike:
        # Two steps, so that no task counts a large key row by row.
        groups_ = members.where(F.col(alike).isNotNull()).groupBy(key, alike).agg(F.count("*").alias("_c"), mass.alias("_cw"))
        top = groups_.groupBy(key).agg(F.max(F.struct("_c", "_cw", F.col(alike).alias("_of"))).alias("_top"))
        sizes = sizes.join(top, key, "left").where("_m > 1 and (_top is null or _m > _top._c)")
        apart = (F.col("_m") > block) & F.col("_top").isNotNull()
        less = lambda whole, part: F.col(whole) - F.when(apart, F.col(part)).otherwise(0)
        sizes = sizes.select(
            key,
            chunks(less("_m", "_top._c"), less("_w", "_top._cw")).alias("_b"),
            F.when(apart, chunks(F.col("_top._c"), F.col("_top._cw"))).otherwise(0).alias("_bt"),
            F.when(apart, F.col("_top._of")).alias("_of"),
        )
    else:
        sizes = sizes.where("_m > 1").select(key, chunks(F.col("_m"), F.col("_w")).alias("_b"), F.lit(0).alias("_bt"))
    # Written before the join, so that both its sides are plain shuffles and Spark can split a large key.
    dealt = members.join(cut(sizes), key)
    inside = F.coalesce(F.col(alike) == F.col("_of"), F.lit(False)) if alike else F.lit(False)
    place = lambda n: F.pmod(F.xxhash64(F.lit(7), F.col(member)), n).cast("int")
    own = F.when(inside, F.col("_b") + place(F.greatest("_bt", F.lit(1)))).otherwise(place(F.col("_b")))
    meets = F.sequence(F.lit(0), F.col("_b") - 1 + F.when(inside, 0).otherwise(F.col("_bt")))
    return (
        dealt.withColumn("chunk", own)
        .withColumn("_o", F.explode(meets))
        .withColumn(
            "cell",
            F.struct(
                F.col(key).alias("k"),
                F.least("chunk", "_o").alias("p"),
                F.greatest("chunk", "_o").alias("q"),
            ),
        )
        .drop("_b", "_bt", "_of", "_o")
    )


def by_cell(df: DataFrame) -> DataFrame:
    """The rows of a cell next to each other in one partition."""
    parts = [F.col("cell.k"), F.col("cell.p"), F.col("cell.q")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = df.select(
        parts[0].alias("k"), parts[1].alias("p"), parts[2].alias("q"), *[c for c in df.columns if c not in ("cell", "k", "p", "q")]
    )
    return flat.repartition(n, "k", "p", "q").sortWithinPartitions("k", "p", "q")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table. Holds one run at most."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            now = tuple(c[a] for c in cols)
            if rest and now != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = now
    if rest:
        yield pa.Table.from_batches(rest)


def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of about ``rows`` rows that part no run of equal keys, with the places where runs begin and end."""
    rest: list[pa.RecordBatch] = []

    def taken(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal rest
        t = pa.Table.from_batches(rest).combine_chunks()
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            c = t[k].to_numpy()
            change |= c[1:] != c[:-1]
        edges = np.array([0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows])
        if not last:
            edges = edges[:-1]
        rest = [] if last else t.slice(int(edges[-1])).to_batches()
        if edges[-1]:
            yield t.slice(0, int(edges[-1])), edges

    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
        if sum(b.num_rows for b in rest) >= rows:
            yield from taken(False)
    if rest:
        yield from taken(True)


def pairs_within(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places a < b between the same two edges."""
    cell = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    a = [np.zeros(0, dtype=np.int64)]
    b = [np.zeros(0, dtype=np.int64)]
    for step in range(1, int(np.diff(edges).max(initial=1))):
        found = np.flatnonzero(cell[step:] == cell[:-step])
        a.append(found)
        b.append(found + step)
    return np.concatenate(a), np.concatenate(b)


def padded(lists: pa.Array, fill: int) -> np.ndarray:
    """Lists of numbers as rows of one width, filled up."""
    n = lists.value_lengths().to_numpy()
    out = np.full((len(lists), int(n.max(initial=1))), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def numbered(column: pa.ChunkedArray) -> np.ndarray:
    """The values as small numbers, equal ones as equal; -1 for a missing one."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each two rows of numbers the least that is in both; the largest number there is if none. Fills must differ."""
    best = np.full(len(left), np.iinfo(np.int64).max)
    for c in range(left.shape[1]):
        hit = (right == left[:, c : c + 1]).any(axis=1)
        best = np.where(hit, np.minimum(best, left[:, c]), best)
    return best


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n points the least point that it is linked with through the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of edges (a long, b long) by alternating large and small stars.

    Returns (node, component): for every node of an edge the least node that it
    reaches. Each half-round takes the least neighbour of a node by a partial
    aggregation and joins it back, so a node with very many neighbours is never
    gathered. Every round is checkpointed; the driver sees only counts.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def node_id(id_col: str, text_hash: Column) -> Column:
    """The id as long; a missing one is replaced by a large negative number made from the text."""
    synthetic = F.lit(-(2**62)) - F.pmod(text_hash, F.lit(2**61))
    return F.coalesce(F.col(id_col).cast("long"), synthetic)
