"""Operator 8: documents whose word n-gram sets have a Jaccard similarity of 0.8 or more, by chosen paths.

A set is sampled into ``SIZE`` min-hash tokens, of which two sets share a fraction
equal to their similarity in the mean. A run is a forest over all sets: at a node
one or two token places are drawn (1 / threshold in the mean, from the node's own
seed), and a set goes to the child that its token there names. Sets follow the
paths of their shared tokens down together. A node with at most ``SMALL`` sets is
compared by brute force; larger ones split further. After ``DEPTH`` levels what is
still large (mostly real near copies) is compared too, in cells of bounded size.
Runs repeat until a pair at the threshold is found with ``RECALL``.

Sets that are equal are collapsed first. In a leaf, sets are first compared by
their tokens; where a pair may reach the threshold, its sets are fetched and
compared exactly. A pair counts in the first leaf that it shares. A leaf returns sums
and a spanning forest for its members, never its pairs.

Jaccard distance is a metric, so sets within half the threshold's distance of one
set are linked with each other for certain. The most usual n-grams of a large leaf
are taken for such a set; those in that ball are counted as a group and need not
meet anywhere. Members of a ball meet only those outside it, by tokens and by
sets, so rows and comparisons of close copies grow with their number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    WORD_BYTES,
    by_cell,
    cells,
    components,
    cut,
    first_shared,
    fresh,
    groups,
    node_id,
    numbered,
    padded,
    pairs_within,
    portions,
    roots,
    sent,
    small_batches,
    table,
    whole_cells,
)

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Tokens of a set; sets of a node that is compared at once; levels; members of a cell's chunk, by tokens and by sets; hashes of a chunk.
SIZE, SMALL, DEPTH, BLOCK, JUDGED, HASHES = 64, 2048, 4, 2048, 1024, 1 << 21
#: Of what may be missed, the share that the comparison of tokens may miss; the rest is left to the paths.
BY_TOKENS = 0.25
#: Members of a large leaf, about, from which the middle of a ball is made.
SAMPLE = 64
#: Bytes of a text that are hashed at a time; n-grams in more sets of a cell than this are compared as a matrix, so many at a time.
PART, RARE, COLUMNS = 1 << 20, 16, 4096
#: Cells of no more members are compared pair by pair, many cells and so many pairs at a time.
FEW, PAIRS = 48, 1 << 16
_U = np.uint64
_TABLE = np.frombuffer(WORD_BYTES, dtype=np.uint8)
_BASE = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_MIXED = mixed(np.arange(256, dtype=np.uint64) + _U(1))


@cache
def _power_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << bits, _BASE), _powers(1 << bits, _INVERSE)


def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words in order, the text taken in parts that end between words."""
    found, a = [], 0
    whole = _TABLE[np.frombuffer(text, dtype=np.uint8)]
    while a < len(whole):
        e = a + PART
        while e < len(whole) and whole[e] != 32:
            gap = np.flatnonzero(whole[e : e + PART] == 32)
            e += int(gap[0]) if len(gap) else PART
        b = whole[a:e]
        a = e
        edge = np.flatnonzero(np.diff((b != 32).astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        power, inverse = _power_table(max(10, len(b).bit_length()))
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_MIXED[b] * power[: len(b)], out=total[1:])
        found.append(mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; with fewer words, of all of them; none without words."""
    hashes = _word_hashes(text or b"")
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    s = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s = mixed(s * _BASE + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(s)


_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, SIZE, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64)


def tokens(s: np.ndarray) -> np.ndarray:
    """SIZE min-hash tokens of 31 bits of a set."""
    low = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096, None] * _A + _B
        np.minimum(low, (part ^ (part >> _U(32))).min(axis=0), out=low)
    return (mixed(low) >> _U(33)).astype(np.int32)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text) to (id, th, digest of the set, its size, tokens, their last bytes)."""
    for whole in batches:
        for batch in portions(whole, 2):
            digests, sizes, tok = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                tok.append(tokens(s) if len(s) else None)
            low = [None if t is None else (t & 255).astype(np.uint8).tobytes() for t in tok]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tok, pa.list_(pa.int32())), pa.array(low, pa.binary())],
                ["id", "th", "digest", "n", "tok", "low"],
            )


def _agreeing(threshold: float) -> list[float]:
    """Chances that 0, 1, ... SIZE tokens of a pair at the threshold agree."""
    return [math.comb(SIZE, k) * threshold**k * (1 - threshold) ** (SIZE - k) for k in range(SIZE + 1)]


def least_agreeing(recall: float, threshold: float) -> int:
    """Agreeing tokens from which a pair goes on to the exact comparison."""
    below, k = 0.0, 0
    for k, chance in enumerate(_agreeing(threshold)):
        below += chance
        if below > BY_TOKENS * (1 - recall):
            break
    return k


def missed(runs: int, least: int, threshold: float) -> float:
    """The chance that a pair at the threshold is not found.

    In a run a pair is lost if its shared paths die out on the way down to DEPTH:
    a node draws one place, or two with a chance of a quarter.
    """
    total = 0.0
    for k, chance in enumerate(_agreeing(threshold)):
        lost = 0.0
        for _ in range(DEPTH):
            gone = 1 - k / SIZE * (1 - lost)
            lost = 0.75 * gone + 0.25 * gone**2
        total += chance * (1.0 if k < least else lost**runs)
    return total


def runs_for(recall: float, threshold: float) -> int:
    """Runs that find a pair at the threshold with the recall, even where its nodes are large down to DEPTH."""
    least, runs = least_agreeing(recall, threshold), 1
    if recall >= 1:
        return 64
    while missed(runs, least, threshold) > 1 - recall:
        runs += 1
    return runs


def _children(parent: Column, tok: Column) -> Column:
    """Paths to the children of a node that a set goes to: one draw, and a second one for one node in four."""

    def child(draw: int) -> Column:
        place = F.pmod(F.xxhash64(parent, F.lit(draw)), F.lit(SIZE)).cast("int")
        return F.xxhash64(parent, place, tok[place])

    second = F.pmod(F.xxhash64(parent, F.lit(99)), F.lit(4)) == 0
    return F.array_distinct(F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0))))


def leaves(sets: DataFrame, runs: int) -> DataFrame:
    """(k, node, m): the leaves of more than one set, and their sizes."""
    roots_ = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(F.lit("run"), r))
    level = sets.select("node", F.explode(F.array_distinct(F.flatten(F.transform(roots_, lambda r: _children(r, F.col("tok")))))).alias("k"))
    out = None
    for depth in range(1, DEPTH + 1):
        # Written before the join, so that both its sides are plain shuffles and Spark can split a large key.
        sizes = cut(level.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"))
        sized = cut(level.join(sizes, "k"))
        leaf = sized if depth == DEPTH else sized.where(F.col("m") <= SMALL)
        out = leaf.select("k", "node", "m") if out is None else out.unionByName(leaf.select("k", "node", "m"))
        if depth == DEPTH:
            break
        large = sized.where(F.col("m") > SMALL)
        if large.isEmpty():
            break
        level = large.join(sets.select("node", "tok"), "node").select("node", F.explode(_children(F.col("k"), F.col("tok"))).alias("k")).distinct()
    return out


def _dominant(members: DataFrame, ball: DataFrame) -> DataFrame:
    """(k, ball, c): of each node the ball that most of its sets are in, and how many. Counted in two steps."""
    counts = members.join(ball.select("node", "ball"), "node").groupBy("k", "ball").agg(F.count("*").alias("c"))
    return counts.groupBy("k").agg(F.max(F.struct("c", "ball")).alias("t")).select("k", "t.ball", "t.c")


def _usual(pdf: pd.DataFrame) -> pd.DataFrame:
    """At each place the token that most of some sets have."""
    tok = np.sort(np.stack(pdf["tok"].to_list()), axis=0)
    half = tok[len(tok) // 2]  # a token of more than half of them is in the middle of the order
    return pd.DataFrame({"home": pdf["home"].iloc[:1], "usual": [half]})


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The n-grams that more than half of some sets have: a set that is near all of them if any is. Also its tokens."""
    found, counts = np.unique(np.concatenate([np.frombuffer(s, dtype=np.uint64) for s in pdf["s"]]), return_counts=True)
    whole = found[counts > len(pdf) / 2]
    s = whole.tobytes()
    return pd.DataFrame({"home": pdf["home"].iloc[:1], "ball": [hashlib.blake2b(s, digest_size=16).digest()], "middle": [s], "usual": [tokens(whole)]})


def _inside(threshold: float):
    """Of (node, ball, middle, s) those whose set is within half the threshold's distance of the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (middle, s) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (middle, s))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= (1 + threshold) / 2 * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["node", "ball"]).take(pa.array(keep, pa.int64()))

    return run


def balls(found_in: DataFrame, sets: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float, small: int) -> DataFrame | None:
    """(node, ball, copies, id) of sets that are all linked with those of the same ball; None if no leaf is large.

    Each set is tried with the middles of the largest and of the smallest of its
    large leaves: the one holds most of its group, the other fewest of other sets. Then
    with the balls that most sets of any of its leaves are in. Leaves with equal
    middles have one ball; of several balls a set takes the largest. Sets are fetched
    (by ``texts``: (node, s) of some nodes) only where tokens agree with the middle's.
    """
    large = found_in.where(F.col("m") > small)
    if large.isEmpty():
        return None
    tok = sets.select("node", "tok")
    agree = F.size(F.filter(F.zip_with("tok", "usual", lambda x, y: x == y), lambda same: same)) >= math.floor(SIZE * threshold)
    ends = large.groupBy("node").agg(F.max(F.struct("m", "k")).alias("most"), F.min(F.struct("m", "k")).alias("least"))
    homes = cut(ends.select("node", F.explode(F.array_distinct(F.array("most.k", "least.k"))).alias("home")))
    sizes = cut(homes.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") >= min(SAMPLE, small)))
    some = F.pmod(F.xxhash64(F.lit(11), "node"), F.ceil(F.col("n") / F.lit(SAMPLE))) == 0
    usual = cut(homes.join(sizes, "home").where(some).join(tok, "node").select("home", "tok").groupBy("home").applyInPandas(_usual, "home long, usual array<int>"))
    tried = cut(homes.join(sizes, "home").join(usual, "home").join(tok, "node").where(agree).select("node", "home", some.alias("some")))
    fetched = cut(texts(tried.select("node")).dropDuplicates(["node"]))
    middles = cut(
        tried.where("some").join(fetched, "node").select("home", "s").groupBy("home")
        .applyInPandas(_middle, "home long, ball binary, middle binary, usual array<int>")
    )
    kinds = cut(middles.select("ball", "middle", "usual").dropDuplicates(["ball"]))

    def inside(pairs: DataFrame, s: DataFrame) -> DataFrame:
        near = pairs.join(s, "node").join(kinds, "ball").select("node", "ball", "middle", "s")
        return cut(near.mapInArrow(_inside(threshold), "node long, ball binary"))

    first = cut(tried.join(middles.select("home", "ball"), "home").select("node", "ball").distinct())
    found = inside(first, fetched)
    met = large.join(cut(_dominant(large, found)), "k").select("node", "ball").distinct()
    second = cut(met.join(first, ["node", "ball"], "left_anti").join(kinds.select("ball", "usual"), "ball").join(tok, "node").where(agree).select("node", "ball"))
    if not second.isEmpty():
        found = found.unionByName(inside(second, texts(second.select("node")).dropDuplicates(["node"])))
    of = cut(found.groupBy("ball").agg(F.count("*").alias("n")))
    best = found.join(of, "ball").groupBy("node").agg(F.max(F.struct("n", "ball")).alias("t")).select("node", "t.ball")
    return cut(best.join(sets.select("node", "copies", "id"), "node"))


def _members(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = g["node"].to_numpy()
    keep = np.unique(ids, return_index=True)[1]
    return ids[keep], keep


def _own_pairs(g: pa.Table, keep: np.ndarray) -> np.ndarray:
    """A matrix of the pairs that this cell compares: those whose first shared leaf is the cell's and that are in no ball together."""
    k, p, q = g["k"][0].as_py(), g["p"][0].as_py(), g["q"][0].as_py()
    own = np.triu(np.ones((len(keep), len(keep)), dtype=bool), 1)
    if p != q:
        chunk = g["chunk"].to_numpy()[keep]
        own &= chunk[:, None] != chunk[None, :]

    def apart(rows: np.ndarray, names: np.ndarray) -> None:
        """Takes the pairs of rows of one name away."""
        order = np.argsort(names, kind="stable")
        rows, names = rows[order], names[order]
        edges = np.flatnonzero(np.diff(names, prepend=names[:1] - 1, append=names[-1:] + 1)) if len(names) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                own[np.ix_(rows[a:b], rows[a:b])] = False

    lists = g["leaves"].combine_chunks().take(pa.array(keep)) if len(keep) else pa.array([], pa.list_(pa.int64()))
    rows, names = np.repeat(np.arange(len(keep)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    apart(rows[names < k], names[names < k])
    ball = numbered(g["ball"])[keep]
    apart(np.flatnonzero(ball >= 0), ball[ball >= 0])
    return own


def _may_reach(threshold: float, least: int):
    """Members of a cell that have a partner by their tokens and sizes. Last bytes of tokens never agree less than tokens do."""

    def sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.minimum(n, m) >= threshold * np.maximum(n, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_cells(batches, ["k", "p", "q"]):
            low = np.frombuffer(b"".join(t["low"].to_pylist()), dtype=np.uint8).reshape(-1, SIZE)
            n = t["n"].to_numpy().astype(np.float64)
            some = np.zeros(len(n), dtype=bool)
            sizes = np.diff(edges)
            few = np.flatnonzero((sizes > 1) & (sizes <= FEW))
            if len(few):
                node, k, chunk, ball = t["node"].to_numpy(), t["k"].to_numpy(), t["chunk"].to_numpy(), numbered(t["ball"])
                across = t["p"].to_numpy() != t["q"].to_numpy()
                lists = t["leaves"].combine_chunks()
                left, right = padded(lists, -1), padded(lists, -2)
                inside = np.concatenate([np.arange(edges[c], edges[c + 1]) for c in few])
                p, q = pairs_within(np.concatenate([[0], np.cumsum(sizes[few])]))
                for i in range(0, len(p), PAIRS):
                    a, b = inside[p[i : i + PAIRS]], inside[q[i : i + PAIRS]]
                    ok = (node[a] != node[b]) & ((chunk[a] != chunk[b]) | ~across[a]) & ((ball[a] != ball[b]) | (ball[a] < 0)) & sized(n[a], n[b])
                    a, b = a[ok], b[ok]
                    ok = (low[a] == low[b]).sum(axis=1) >= least
                    a, b = a[ok], b[ok]
                    ok = first_shared(left[a], right[b]) == k[a]
                    some[a[ok]] = some[b[ok]] = True
            for c in np.flatnonzero(sizes > FEW):
                e, rows = edges[c], np.arange(sizes[c])
                own = _own_pairs(t.slice(int(e), int(sizes[c])), rows)
                mine, m = low[e : edges[c + 1]], n[e : edges[c + 1]]
                for i in range(0, len(rows), 256):
                    at = i + np.flatnonzero(own[i : i + 256].any(axis=1))
                    if not len(at):
                        continue
                    agree = np.zeros((len(at), len(rows)), dtype=np.uint8)
                    for column in range(SIZE):
                        agree += mine[at, column : column + 1] == mine[None, :, column]
                    hit = own[at] & (agree >= least) & sized(m[at, None], m)
                    some[e + at] |= hit.any(axis=1)
                    some[e : edges[c + 1]] |= hit.any(axis=0)
            if some.any():
                yield from t.select(["k", "node", "n", "ball"]).take(pa.array(np.flatnonzero(some))).combine_chunks().to_batches()

    return run


def _overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: rare hashes pair by pair, frequent ones as a matrix, those of a single set not at all."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    rows, often = rows[order], np.repeat(counts, counts)
    out = np.zeros(m * m, dtype=np.float32)
    few = often <= RARE
    r, c = rows[few], column[order][few]
    for step in range(1, RARE):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        out += np.bincount(r[same] * m + r[same + step], minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    out += out.T
    r, sizes = rows[~few], counts[counts > RARE]
    place = np.repeat(np.arange(len(sizes)), sizes)
    for start in range(0, len(sizes), COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        x = np.zeros((m, min(COLUMNS, len(sizes) - start)), dtype=np.float32)
        x[r[a:b], place[a:b] - start] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["k", "p", "q"]):
            ids, keep = _members(g)
            if len(ids) < 2:
                continue
            own = _own_pairs(g, keep)
            col = g["s"].combine_chunks()
            sets = [np.frombuffer(col[int(i)].as_buffer(), dtype=np.uint64) for i in keep]
            n = np.array([len(s) for s in sets], dtype=np.float64)
            both = _overlap(sets)
            a, b = np.nonzero(own & (both > 0))
            both = both[a, b].astype(np.float64)
            linked = both >= threshold * (n[a] + n[b] - both) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            copies = g["copies"].to_numpy()[keep]
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            root = ids[roots(len(ids), a, b)]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["node", "links", "root"]
            )

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in portions(whole, 1):
            s = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], ["node", "s"])


def similar_documents(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    judged: int = JUDGED,
) -> DataFrame:
    """(id, text_hash, class_id, n_links, component_id, kept, has_words) for every row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
    case. Documents of five words or more are the set of their 5-grams; those of
    fewer words the set of one gram, all their words; those without words, or
    without a text, link with nothing. class_id is the smallest id with an equal set,
    n_links the number of other documents at the threshold or above, component_id
    the smallest id that links reach, kept whether that is the document's own.

    Rows that repeat an id are documents of their own, each with the links of its
    own text. A missing id is replaced by a negative one made from the
    text. Other columns are not looked at; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    th = F.xxhash64(text)
    rows = docs.select(node_id(id_col, th).alias("id"), th.alias("th"), text.cast("binary").alias("text"))
    sketched = cut(rows.mapInArrow(sketch, "id long, th long, digest binary, n int, tok array<int>, low binary"))
    classes = (
        sketched.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "tok", "low")])
    )
    # Numbers of rows as they are written once and for all.
    sets = cut(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "rep.id", "rep.th", "copies", "n", "tok", "low"))

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, s): the sets of some nodes, from the texts of their first documents."""
        wanted = cut(sets.join(nodes.distinct(), "node").select("node", "id", "th"))
        return rows.join(sent(wanted, 64), ["id", "th"]).select("node", "text").mapInArrow(_shingle_sets, "node long, s binary")

    found_in = cut(leaves(sets, runs_for(recall, threshold)))
    per_set = found_in.groupBy("node").agg(F.array_sort(F.collect_set("k")).alias("leaves"))
    ball = balls(found_in, sets, texts, threshold, block)
    if ball is None:
        about, alike = per_set.withColumn("ball", F.lit(None).cast("binary")), None
    else:
        about, alike = per_set.join(ball.select("node", "ball"), "node", "left"), "ball"
        found_in = found_in.join(ball.select("node", "ball"), "node", "left")
    placed = cells(found_in, "k", "node", block, alike=alike).select("cell", "chunk", "node")
    probes = placed.join(about, "node").join(sets.select("node", "n", "low"), "node")
    near = cut(by_cell(probes).mapInArrow(_may_reach(threshold, least_agreeing(recall, threshold)), "k long, node long, n int, ball binary").distinct())
    full = texts(near.select("node")).join(sets.select("node", "copies"), "node").join(about, "node")
    placed = cells(near, "k", "node", judged, "n", HASHES, alike=alike).select("cell", "chunk", "node")
    found = cut(by_cell(placed.join(full, "node")).mapInArrow(_verify(threshold), "node long, links long, root long"))
    if ball is not None:
        whole = ball.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("node").alias("root"))
        found = found.unionByName(ball.join(cut(whole), "ball").select("node", (F.col("all") - F.col("copies")).alias("links"), "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = components(edges)
    first = comp.join(sets.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = (
        sets.select("node", "digest", "id", "copies")
        .join(links, "node", "left")
        .join(comp.join(first, "component").select("node", "component_id"), "node", "left")
        .select(
            "digest",
            F.col("id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    component = F.coalesce("component_id", "id")
    return sketched.select("id", "th", "digest").join(cut(per_class), "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("th").alias("text_hash"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
        F.col("digest").isNotNull().alias("has_words"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``similar_documents`` keeps: one of each group. Of rows equal in id and text one stays.

    Texts without a word have no n-grams; of those that are equal, that with the
    smallest id stays. A missing text equals no other and stays.
    """
    th = F.xxhash64(F.col(text_col))
    key = [fresh("id_of", docs.columns), fresh("hash_of", docs.columns)]
    judged = similar_documents(docs, id_col=id_col, text_col=text_col, **options).select(
        F.col(id_col).alias(key[0]), F.col("text_hash").alias(key[1]), "kept", "has_words"
    )
    with_words = judged.where("kept and has_words").select(*key)
    wordless = judged.where("not has_words").groupBy(key[1]).agg(F.min(key[0]).alias(key[0])).select(*key)
    keyed = docs.select("*", node_id(id_col, th).alias(key[0]), th.alias(key[1]))
    chosen = keyed.join(with_words.unionByName(wordless).distinct(), key, "left_semi").dropDuplicates(key)
    return chosen.where(F.col(text_col).isNotNull()).unionByName(keyed.where(F.col(text_col).isNull())).select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "class_id", "n_links", "component_id", "kept")


SQL: dict[str, str] = {
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM g GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM n),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o.c >= 0.8 * (x.n + y.n - o.c) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
d AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT documents.doc_id, coalesce(c.class_id, documents.doc_id) AS class_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links,
       comp.component_id, documents.doc_id = comp.component_id AS kept
FROM documents LEFT JOIN c USING (doc_id) JOIN comp USING (doc_id) LEFT JOIN d USING (doc_id)
"""
}
