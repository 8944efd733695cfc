"""Density clusters of deck vectors, and the attachment of what is left to the nearest centroid.

Clusters are made for each slice (a format and month, say) by itself, many slices
at a time. Decks that share no card are at distance 1 and never compared: decks meet
by a join on the cards that few of a slice's decks have. Those with a more frequent
card are dealt into chunks; each two chunks are a cell, whose task keeps a spanning
forest of its own pairs. An edge that is the longest of a cycle in its cell is the
longest of one in the slice, so the slice's tree is among the edges kept. Those are
merged in buckets of bounded size until a slice has one, and only that list of edges,
never vectors, goes to the step that condenses the tree. Attaching is plain joins over
all slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import cut

NOISE = -1
#: Least decks of a cluster, and least cosine for attaching.
LEAST_SIZE, TAU = 5, 0.3
#: Decks of a chunk, about; edges of a slice that one task merges at least, and for each deck of the slice.
BLOCK, EDGES, PER_DECK = 512, 1 << 17, 4
#: Cards in more decks of a cell than this are multiplied as a matrix, so many at a time; others pair by pair.
RARE, COLUMNS = 32, 4096


def spanning_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of the cosine distances of unit rows, shortest edges first.

    Distances are rounded to 12 digits, so the order of sums does not matter; of
    equal edges that with the smaller row comes first.
    """
    n = len(x)
    near, of = np.full(n, np.inf), np.zeros(n, dtype=int)
    out, left, now = [], np.ones(n, dtype=bool), 0
    left[:1] = False
    for _ in range(n - 1):
        d = np.round(1.0 - x @ x[now], 12)
        closer = left & (d < near)
        near[closer], of[closer] = d[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
        left[now] = False
        out.append((max(0.0, float(near[now])), min(now, int(of[now])), max(now, int(of[now]))))
    return sorted(out)


def density_clusters(x: np.ndarray, least: int = LEAST_SIZE) -> np.ndarray:
    """Labels of unit rows from 0 in order of each cluster's first row; -1 for noise."""
    return condense(len(x), spanning_tree(x), least)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges between n points, shortest first, make the minimum spanning forest.

    In each round every part takes its first edge. No two edges are equal, as
    their places differ, so the forest is the only one.
    """
    label, alive, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, dtype=int)]
    while True:
        alive = alive[label[a[alive]] != label[b[alive]]]
        if not len(alive):
            return np.sort(np.concatenate(kept))
        first = np.full(n, len(a))
        np.minimum.at(first, label[a[alive]], alive)
        np.minimum.at(first, label[b[alive]], alive)
        taken = np.unique(first[first < len(a)])
        kept.append(taken)
        left, right = label[a[taken]], label[b[taken]]
        while (label[left] != label[right]).any():
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            while (label != label[label]).any():
                label = label[label]


def near_pairs(n: int, row: np.ndarray, card: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, a, b), a < b, of the pairs of rows at a distance below 1; distances as in ``spanning_tree``."""
    order = np.lexsort((row, card))
    row, card, weight = row[order], card[order], weight[order]
    counts = np.unique(card, return_counts=True)[1]
    often = np.repeat(counts, counts)
    sim = np.zeros(n * n)
    r, c, w = (v[often <= RARE] for v in (row, card, weight))
    for step in range(1, int(min(RARE, counts.max(initial=0)))):
        same = np.flatnonzero(c[step:] == c[:-step])
        if len(same):
            np.add.at(sim, r[same] * n + r[same + step], w[same] * w[same + step])
    sim = sim.reshape(n, n)
    r, w = row[often > RARE], weight[often > RARE]
    column = np.repeat(np.arange((counts > RARE).sum()), counts[counts > RARE])
    for start in range(0, int((counts > RARE).sum()), COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((n, int(column[j - 1]) - start + 1))
        m[r[i:j], column[i:j] - start] = w[i:j]
        sim += m @ m.T
    a, b = np.nonzero(np.triu(np.round(1.0 - sim, 12) < 1.0, 1))
    return np.maximum(0.0, np.round(1.0 - sim[a, b], 12)), a, b


def condense(n: int, tree: list[tuple[float, int, int]], least: int = LEAST_SIZE) -> np.ndarray:
    """Labels from 0 in order of each cluster's first row; -1 for noise. tree: n - 1 edges, shortest first.

    The single-linkage tree is condensed to parts of ``least`` rows or more, and
    those of the greatest excess of mass are the clusters; the whole is none.
    """
    labels = np.full(n, NOISE)
    if n < max(least, 2):
        return labels
    parent = list(range(2 * n - 1))
    children: dict[int, tuple[int, int, float]] = {}
    size = [1] * n

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (d, a, b) in enumerate(tree):
        a, b = top(a), top(b)
        new = n + k
        parent[a] = parent[b] = new
        children[new] = (a, b, 1.0 / max(d, 1e-12))
        size.append(size[a] + size[b])

    def rows(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += children[j][:2]
        return out

    # The condensed tree: a part's mass and the parts below it. Parts are named by the tree node that they begin at.
    root = 2 * n - 2
    mass, below, order, todo = {}, {}, [], [(root, 0.0)]
    while todo:
        part, birth = todo.pop()
        order.append(part)
        mass[part], below[part] = 0.0, []
        at = part
        while at >= n:
            a, b, level = children[at]
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                mass[part] += size[at] * (level - birth)
                below[part] = [a, b]
                todo += [(a, level), (b, level)]
                break
            gone = sum(size[c] for c in (a, b) if size[c] < least)
            mass[part] += gone * (level - birth)
            if not big:
                break
            at = big[0]
    chosen: dict[int, bool] = {}
    for part in reversed(order):
        inner = sum(mass[c] for c in below[part])
        chosen[part] = part != root and (not below[part] or mass[part] >= inner)
        if not chosen[part]:
            mass[part] = max(mass[part], inner) if part == root else inner
    found, todo = [], [root]
    while todo:
        part = todo.pop()
        if chosen[part]:
            found.append(sorted(rows(part)))
        else:
            todo += below[part]
    for k, members in enumerate(sorted(found)):
        labels[members] = k
    return labels


def _first_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """The spanning forest of the pairs that a cell compares: between its two chunks, or within the one."""
    pdf = pdf.sort_values("deck_id").reset_index(drop=True)
    row = np.repeat(np.arange(len(pdf)), pdf["cards"].map(len))
    card, weight = np.concatenate(pdf["cards"].tolist()), np.concatenate(pdf["weights"].tolist())
    d, a, b = near_pairs(len(pdf), row, np.unique(card, return_inverse=True)[1], weight)
    if pdf["p"].iloc[0] != pdf["q"].iloc[0]:
        chunk = pdf["chunk"].to_numpy()
        across = chunk[a] != chunk[b]
        d, a, b = d[across], a[across], b[across]
    return _kept(pdf["slice"].iloc[0], pdf["deck_id"].to_numpy(), d, a, b)


def _kept(part: object, ids: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((b, a, d))
    keep = order[forest(len(ids), a[order], b[order])]
    return pd.DataFrame({"slice": pd.Series([part] * len(keep), dtype=object), "d": d[keep], "a": ids[a[keep]], "b": ids[b[keep]]})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    return _kept(pdf["slice"].iloc[0], ids, pdf["d"].to_numpy(), ends[: len(pdf)], ends[len(pdf) :])


def tree_edges(vectors: DataFrame, decks: DataFrame, block: int = BLOCK, edges: int = EDGES) -> DataFrame:
    """(slice, d, a, b): edges below distance 1 that hold the minimum spanning forest of each slice.

    At most ``PER_DECK`` for each deck of a slice, or ``edges``. A card is frequent in a slice if more decks than the
    slice's number of chunks have it: then a deck meets no more others by a card than it would have cells.
    """
    members = decks.select("slice", "deck_id").distinct()
    sizes = cut(members.groupBy("slice").agg(F.count("*").alias("n")))
    # A card counts once in a deck; one that no other deck of the slice has makes no pair.
    lines = vectors.groupBy("slice", "deck_id", "card_id").agg(F.max("weight").cast("double").alias("weight")).join(members, ["slice", "deck_id"], "left_semi")
    shared = lines.withColumn("having", F.count("*").over(W.partitionBy("slice", "card_id"))).where("having > 1")
    shared = cut(shared.join(F.broadcast(sizes), "slice").withColumn("often", F.col("having") > F.ceil(F.col("n") / block)).drop("n", "having"))
    often = cut(shared.where("often").select("slice", "deck_id").distinct())

    rows = shared.join(often, ["slice", "deck_id"], "left_semi").groupBy("slice", "deck_id")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("card_id", "weight"))).alias("v"))
    rows = rows.select("slice", "deck_id", F.col("v.card_id").alias("cards"), F.col("v.weight").alias("weights"))
    dealt = rows.join(F.broadcast(often.groupBy("slice").agg(F.ceil(F.count("*") / block).alias("m"))), "slice")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "deck_id"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    celled = dealt.select(
        "slice", "deck_id", "cards", "weights", "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q")
    )
    kinds = dict(rows.dtypes)
    kind = f"slice {kinds['slice']}, d double, a {kinds['deck_id']}, b {kinds['deck_id']}"
    in_cells = celled.groupBy("slice", "p", "q").applyInPandas(_first_edges, kind)

    # Two decks of which one is in no cell share only cards that few decks have.
    few = shared.where("not often").drop("often").join(often.withColumn("celled", F.lit(True)), ["slice", "deck_id"], "left")
    one, two = (few.select("slice", "card_id", F.col("deck_id").alias(k), F.col("weight").alias(f"w{k}"), F.col("celled").alias(f"c{k}")) for k in "ab")
    met = one.join(two, ["slice", "card_id"]).where("a < b and (ca is null or cb is null)")
    near = met.groupBy("slice", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    near = near.withColumn("d", F.rint((1.0 - F.col("sim")) * 1e12) / 1e12).where("d < 1")  # as in ``near_pairs``
    found = cut(in_cells.unionByName(near.select("slice", F.greatest("d", F.lit(0.0)).alias("d"), "a", "b")))
    while True:
        size = found.groupBy("slice").agg(F.count("*").alias("e")).join(F.broadcast(sizes), "slice")
        size = size.select("slice", F.ceil(F.col("e") / F.greatest(F.lit(edges), F.col("n") * PER_DECK)).alias("m"))
        size = cut(size.where("m > 1"))
        if size.isEmpty():
            return found
        large = found.join(F.broadcast(size), "slice").withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.col("m")))
        merged = large.groupBy("slice", "bucket").applyInPandas(_merged, kind)
        found = cut(merged.unionByName(found.join(F.broadcast(size), "slice", "left_anti")))


def cluster_slices(
    vectors: DataFrame, decks: DataFrame, least: int = LEAST_SIZE, most: int | None = None, block: int = BLOCK, edges: int = EDGES
) -> DataFrame:
    """(slice, deck_id, cluster) of every deck.

    vectors: slice, deck_id, card_id, weight; decks: slice, deck_id. Weights are
    of decks of length one. Clusters are numbered within a slice. A deck without a
    card is noise; a repeated one counts once. Slices may be of any size, unless
    ``most`` is given: then one of more decks raises.
    """
    found = tree_edges(vectors, decks, block, edges)

    def run(members: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(members) > most:
            raise ValueError(f"slice {members['slice'].iloc[0]!r} has {len(members)} decks, more than {most}; cut finer slices")
        ids, place = np.unique(members["deck_id"].to_numpy(), return_inverse=True)
        d, a, b = pdf["d"].to_numpy(), np.searchsorted(ids, pdf["a"].to_numpy()), np.searchsorted(ids, pdf["b"].to_numpy())
        order = np.lexsort((b, a, d))
        order = order[forest(len(ids), a[order], b[order])]
        d, a, b = d[order], a[order], b[order]
        # Parts that share nothing are at distance 1, and joined in the order of their first decks.
        far = np.arange(1, len(ids))
        far = far[forest(len(ids), np.append(a, far * 0), np.append(b, far))[len(a) :] - len(a)]
        tree = list(zip(np.append(d, far * 0 + 1.0).tolist(), np.append(a, far * 0).tolist(), np.append(b, far).tolist()))
        return pd.DataFrame({"slice": members["slice"], "deck_id": members["deck_id"], "cluster": condense(len(ids), tree, least)[place]})

    kinds = dict(decks.dtypes)
    both = decks.select("slice", "deck_id").groupBy("slice").cogroup(found.groupBy("slice"))
    return both.applyInPandas(run, f"slice {kinds['slice']}, deck_id {kinds['deck_id']}, cluster int")


def linked_parts(vectors: DataFrame, decks: DataFrame, most: float, block: int = BLOCK, edges: int = EDGES) -> DataFrame:
    """(slice, deck_id, part): single linkage at one distance below 1; decks that chains of distances up to ``most`` join have one part, its least deck.

    Input as for ``cluster_slices``. A deck without a card is a part of its own.
    """
    if not 0 <= most < 1:
        raise ValueError("decks that share nothing are at distance 1; give a smaller one")
    found = tree_edges(vectors, decks, block, edges).where(F.col("d") <= most)

    def run(members: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(members["deck_id"].to_numpy(), return_inverse=True)
        label, a, b = np.arange(len(ids)), np.searchsorted(ids, pdf["a"].to_numpy()), np.searchsorted(ids, pdf["b"].to_numpy())
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
        return pd.DataFrame({"slice": members["slice"], "deck_id": members["deck_id"], "part": ids[label][place]})

    kinds = dict(decks.dtypes)
    both = decks.select("slice", "deck_id").groupBy("slice").cogroup(found.groupBy("slice"))
    return both.applyInPandas(run, f"slice {kinds['slice']}, deck_id {kinds['deck_id']}, part {kinds['deck_id']}")


def centroids(vectors: DataFrame, clustered: DataFrame) -> DataFrame:
    """(slice, cluster, card_id, weight): mean vectors of clusters, scaled to length one."""
    members = clustered.where(F.col("cluster") != NOISE)
    n = members.groupBy("slice", "cluster").agg(F.count("*").alias("n"))
    sums = vectors.join(members, ["slice", "deck_id"]).groupBy("slice", "cluster", "card_id").agg(F.sum("weight").alias("s"))
    mean = sums.join(n, ["slice", "cluster"]).select("slice", "cluster", "card_id", (F.col("s") / F.col("n")).alias("m"))
    norm = mean.groupBy("slice", "cluster").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, ["slice", "cluster"]).select(
        "slice", "cluster", "card_id", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("weight")
    )


def attach_noise(vectors: DataFrame, clustered: DataFrame, tau: float = TAU) -> DataFrame:
    """(slice, deck_id, cluster): noise goes to the nearest centroid if its cosine is ``tau`` or more.

    Of equally near clusters the smallest wins. Clustered decks stay. Weights are not
    negative, as those of TF-IDF are, or all cards of all centroids are in each deck. With tau at 0 or
    below, decks that share no card with any centroid go to the smallest cluster.
    """
    noise = clustered.where(F.col("cluster") == NOISE).select("slice", "deck_id")
    near = (
        vectors.join(noise, ["slice", "deck_id"], "left_semi")
        .join(centroids(vectors, clustered).withColumnRenamed("weight", "c"), ["slice", "card_id"])
        .groupBy("slice", "deck_id", "cluster")
        .agg(F.round(F.sum(F.col("weight") * F.col("c")), 12).alias("sim"))
    )
    best = near.groupBy("slice", "deck_id").agg(F.min(F.struct((-F.col("sim")).alias("minus"), "cluster")).alias("b"))
    best = best.select("slice", "deck_id", (-F.col("b.minus")).alias("sim"), F.col("b.cluster").alias("to"))
    lowest = clustered.where(F.col("cluster") != NOISE).groupBy("slice").agg(F.min("cluster").alias("lowest"))
    rows = clustered.join(best, ["slice", "deck_id"], "left").join(lowest, "slice", "left")
    sim = F.coalesce("sim", F.lit(0.0))
    to = F.when(sim >= tau, F.coalesce("to", "lowest"))
    return rows.select(
        "slice", "deck_id", F.when(F.col("cluster") != NOISE, F.col("cluster")).otherwise(F.coalesce(to, F.lit(NOISE))).cast("int").alias("cluster")
    )


def cluster_and_attach(vectors: DataFrame, decks: DataFrame, least: int = LEAST_SIZE, tau: float = TAU) -> DataFrame:
    # Attaching reads the clusters several times; they are made once.
    return attach_noise(vectors, cut(cluster_slices(vectors, decks, least)), tau)
