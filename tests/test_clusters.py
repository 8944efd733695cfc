from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom.operators import clusters, evaluate, trends, vectors


def blobs(seed=0, sizes=(8, 7, 9), strays=3):
    rng = np.random.default_rng(seed)
    rows = [np.eye(12)[3 * k] + rng.normal(0, 0.05, 12) for k, n in enumerate(sizes) for _ in range(n)]
    rows += [np.eye(12)[9 + k] for k in range(strays)]
    x = np.abs(np.array(rows))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_blobs_are_found():
    labels = clusters.density_clusters(blobs())
    assert labels.tolist()[:24] == [0] * 8 + [1] * 7 + [2] * 9
    assert set(labels.tolist()[24:]) <= {-1}


def test_few_rows_are_noise():
    assert (clusters.density_clusters(blobs(sizes=(4,), strays=0)) == -1).all()
    assert clusters.density_clusters(np.zeros((0, 3))).tolist() == []


def test_equal_rows_make_a_cluster():
    x = np.repeat(np.eye(3), 6, axis=0)
    assert clusters.density_clusters(x).tolist() == [0] * 6 + [1] * 6 + [2] * 6


def test_order_of_rows_does_not_matter():
    x, order = blobs(3), np.random.default_rng(1).permutation(27)
    a, b = clusters.density_clusters(x), clusters.density_clusters(x[order])
    same = lambda v: v[:, None] == v[None, :]
    assert (same(a)[np.ix_(order, order)] | (a[order] == -1)[:, None] == same(b) | (b == -1)[:, None]).all()


def test_spanning_tree_is_minimal():
    x = blobs(5)
    d = np.round(1 - x @ x.T, 12)
    parent = list(range(len(x)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for w, a, b in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i)):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            total += max(0.0, w)
    assert sum(w for w, _, _ in clusters.spanning_tree(x)) == pytest.approx(total)


def plain_clusters(x, least):
    """The definition read plainly: parts at every distance, those that are born and die, the choice with the most mass."""
    n = len(x)
    d = np.maximum(0.0, np.round(1 - x @ x.T, 12))
    # Ties are cut one edge at a time, as the tree has them.
    tree = clusters.spanning_tree(x)
    assert sum(w for w, *_ in tree) == pytest.approx(sum(sorted_kruskal(d)))

    def parts(edges, rows):
        """Connected parts of rows by some edges."""
        left, out = set(rows), []
        while left:
            found, todo = set(), [min(left)]
            while todo:
                a = todo.pop()
                if a not in found:
                    found.add(a)
                    todo += [q for _, p, q in edges if p == a] + [p for _, p, q in edges if q == a]
            found &= set(rows)
            left -= found
            out.append(frozenset(found))
        return out

    def grow(rows, birth, edges):
        """(mass, clusters below) of a part that begins with density ``birth``: its longest edges go one by one."""
        mass, rows = 0.0, frozenset(rows)
        while True:
            inside = [e for e in edges if e[1] in rows and e[2] in rows]
            if not inside:
                return mass, []
            longest = inside[-1]
            level = 1 / max(longest[0], 1e-12)
            big = [p for p in parts(inside[:-1], rows) if len(p) >= least]
            if len(big) == 2:
                return mass + len(rows) * (level - birth), [(p, level, inside[:-1]) for p in big]
            if not big:
                return mass + len(rows) * (level - birth), []
            mass += (len(rows) - len(big[0])) * (level - birth)
            rows, edges = big[0], inside[:-1]

    def best(rows, birth, edges, whole):
        """(mass, chosen sets of rows): the part itself, or what is best below it."""
        mass, below = grow(rows, birth, edges)
        inner = [best(*b, False) for b in below]
        if whole or (below and sum(m for m, _ in inner) > mass):
            return sum(m for m, _ in inner), [s for _, chosen in inner for s in chosen]
        return mass, [frozenset(rows)]

    return {s for s in best(range(n), 0.0, tree, True)[1]}


def sorted_kruskal(d):
    part, out = list(range(len(d))), []
    for w, a, b in sorted((d[i, j], i, j) for i in range(len(d)) for j in range(i)):
        if part[a] != part[b]:
            out.append(w)
            part = [part[a] if p == part[b] else p for p in part]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_clusters_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(3, 10, rng.integers(2, 5))
    x = np.abs(np.concatenate([np.eye(8)[rng.integers(8)] + rng.normal(0, rng.choice([0.03, 0.2]), (n, 8)) for n in sizes] + [rng.random((4, 8))]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for least in (2, 3, 5):
        labels = clusters.density_clusters(x, least)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}} == plain_clusters(x, least)
        firsts = [int(np.flatnonzero(labels == k)[0]) for k in range(labels.max() + 1)]
        assert firsts == sorted(firsts)


@pytest.fixture(scope="module")
def long_form(spark):
    x = blobs()
    rows = [("s", i, c, float(x[i, c])) for i in range(len(x)) for c in range(12) if x[i, c]]
    return (
        spark.createDataFrame(rows, "slice string, deck_id long, card_id long, weight double"),
        spark.createDataFrame([("s", i) for i in range(len(x) + 1)], "slice string, deck_id long"),
    )


def test_slices(spark, long_form):
    vecs, decks = long_form
    two = vecs.unionByName(vecs.withColumn("slice", F.lit("t"))), decks.unionByName(decks.withColumn("slice", F.lit("t")))
    rows = clusters.cluster_slices(*two).orderBy("slice", "deck_id").collect()
    assert len(rows) == 56 and [r["cluster"] for r in rows[:28]] == [r["cluster"] for r in rows[28:]]
    assert rows[27]["cluster"] == -1  # a deck without a card
    with pytest.raises(Exception, match="more than 5"):
        clusters.cluster_slices(vecs, decks, most=5).count()


def test_cells_and_buckets_change_nothing(spark):
    rng = np.random.default_rng(4)
    x = rng.random((90, 30)) * (rng.random((90, 30)) < 0.08) + np.repeat(np.eye(30)[:3], 30, axis=0) * rng.random((90, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("s", i, c, float(x[i, c])) for i in range(90) for c in range(30) if x[i, c]]
    vecs = spark.createDataFrame(rows, "slice string, deck_id long, card_id long, weight double")
    decks = spark.createDataFrame([("s", i) for i in range(90)], "slice string, deck_id long")
    want = clusters.density_clusters(x).tolist()
    assert max(want) > 0
    for block, edges in ((512, 1 << 17), (8, 20)):
        got = clusters.cluster_slices(vecs, decks, block=block, edges=edges).orderBy("deck_id").collect()
        assert [r["cluster"] for r in got] == want


def test_large_slice(spark, long_form):
    vecs, decks = long_form
    more = decks.unionByName(spark.range(100, 20_200).select(F.lit("s").alias("slice"), F.col("id").alias("deck_id")))
    got = clusters.cluster_slices(vecs, more)
    assert got.count() == 20_128 and got.where("cluster = -1").count() == 20_128 - 24


@pytest.mark.parametrize("tau, noise", [(1.01, 4), (0.3, 4), (0.0, 0)])
def test_attach(long_form, tau, noise):
    vecs, decks = long_form
    first = clusters.cluster_slices(vecs, decks).cache()
    after = clusters.attach_noise(vecs, first, tau)
    assert after.where("cluster = -1").count() == noise
    kept = first.where("cluster <> -1").exceptAll(after.where("cluster <> -1"))
    assert kept.isEmpty()


def test_attach_without_clusters(long_form):
    vecs, decks = long_form
    alone = decks.withColumn("cluster", F.lit(-1))
    assert clusters.attach_noise(vecs, alone, 0.0).where("cluster <> -1").count() == 0


def test_tf_idf(spark):
    entries = [(1, 1, 4, "main"), (1, 2, 1, "main"), (2, 1, 2, "main"), (2, 3, 1, "main"), (3, 9, 5, "main"), (3, 2, 1, "side")]
    cards = spark.createDataFrame(entries, "deck_id long, card_id long, count int, board string")
    decks = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "deck_id long")
    rows = vectors.tf_idf(cards, decks, spark.createDataFrame([(9,)], "card_id long")).collect()
    w = {(r["deck_id"], r["card_id"]): r["weight"] for r in rows}
    assert set(w) == {(1, 1), (1, 2), (2, 1), (2, 3)}
    idf = lambda df: np.log(5 / (1 + df)) + 1
    raw = np.array([4 * idf(2), idf(1)])
    assert [w[1, 1], w[1, 2]] == pytest.approx(list(raw / np.linalg.norm(raw)))


def pairs(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_majority_and_scores(spark):
    clustered = pairs(spark, [(k, c) for k, c in enumerate([0, 0, 0, 0, 1, 1, 2, -1, -1])], "deck_id long, cluster int")
    truth = pairs(spark, [(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (7, "c")], "deck_id long, truth string")
    labels = {r["cluster"]: r["label"] for r in evaluate.majority_labels(clustered, truth).collect()}
    assert labels == {0: "a", 1: "c", 2: None}
    judged = evaluate.predictions(clustered, truth)
    got = {r["label"]: tuple(r)[1:] for r in evaluate.per_label(judged, least=2).collect()}
    assert got["a"] == (2, 0.5, 1.0, pytest.approx(2 / 3)) and got["b"] == (2, 0.0, 0.0, 0.0) and got["c"] == (2, 1.0, 0.5, pytest.approx(2 / 3))
    assert tuple(evaluate.agreement(judged, least=2).first()) == (6, 3, 0.5)
    assert tuple(evaluate.agreement(judged, least=50).first()) == (0, 0, 0.0)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", 0), ("a", 0), ("b", 1), ("b", 1)], 1.0),
        ([("a", 0), ("a", 1), ("b", 0), ("b", 1)], -0.5),
        ([("a", 0), ("a", 0), ("b", 1), ("b", -1)], 0.5714285714285714),
        ([("a", 0)], 1.0),
        ([], 1.0),
    ],
)
def test_adjusted_rand(spark, rows, want):
    assert evaluate.adjusted_rand(pairs(spark, rows, "t string, c int"), "t", "c").first()["ari"] == pytest.approx(want)


def test_emergence(spark):
    start = date(2024, 1, 1)
    rows = [(k, start + timedelta(days=k)) for k in range(20)]
    decks = pairs(spark, rows, "deck_id long, date date")
    targets = decks.where("deck_id % 2 = 0")

    def by_parity(slices):
        return slices.withColumn("cluster", (F.col("deck_id") % 2).cast("int"))

    found = evaluate.emergence(decks, targets, by_parity)
    assert (found.first, found.detected_on, found.size, found.purity) == (start + timedelta(days=8), start + timedelta(days=8), 5, 1.0)
    mixed = evaluate.emergence(decks, targets, lambda s: s.withColumn("cluster", F.lit(0)))
    assert mixed.detected_on == start + timedelta(days=8) and mixed.size == 9
    late = evaluate.emergence(decks, targets, lambda s: s.withColumn("cluster", F.lit(-1)))
    assert not late.passed and late.deadline == start + timedelta(days=15)
    assert not evaluate.emergence(decks, targets.limit(4), by_parity).passed
    assert evaluate.verdict(0.96, 0.91, [found]) == {"agreement": True, "f1": True, "emergence": True}


def test_remainder_leaves_conflicts_out(spark):
    decks = pairs(spark, [(k,) for k in range(4)], "deck_id long")
    classified = pairs(spark, [(0, "rules", ["a", "b"]), (1, "fallback", []), (2, None, [])], "deck_id long, method string, conflict array<string>")
    assert sorted(r[0] for r in evaluate.remainder(decks, classified).collect()) == [1, 2, 3]
    assert evaluate.ground_truth(classified.withColumn("archetype", F.lit("x"))).count() == 0


def test_deterministic(spark, long_form):
    vecs, decks = long_form
    assert evaluate.deterministic(lambda: clusters.cluster_and_attach(vecs, decks))


def test_trends(spark):
    rows = [(date(2024, 1, 1), "a", 2, 1), (date(2024, 1, 1), "b", 0, 1), (date(2024, 1, 8), "a", None, None), (date(2024, 2, 1), "a", 9, 0)]
    labelled = pairs(spark, rows, "date date, label string, wins int, losses int")
    rates = {r["label"]: (r["games"], r["rate"]) for r in trends.win_rates(labelled, F.lit("2024-01-15").cast("date")).collect()}
    assert rates["a"] == (1.5, pytest.approx(2 / 3.5)) and rates["b"] == (0.5, pytest.approx(1 / 2.5))
    shares = trends.daily_share(labelled)
    assert {(r["date"].day, r["label"]): r["share"] for r in shares.where("date < '2024-02-01'").collect()} == {(1, "a"): 0.5, (1, "b"): 0.5, (8, "a"): 1.0}
    assert [tuple(r) for r in trends.persistence_error(shares).collect()] == [("a", 1, 0.5)]
    flat = {r["label"]: r["forecast"] for r in trends.smoothed(shares, ahead=1).collect()}
    assert flat["b"] == 0.5 and flat["a"] > 0.5
    p = pairs(spark, [(0.9, True), (0.9, False), (0.1, False)], "rate double, won boolean")
    assert {r["bin"]: (r["n"], r["observed"]) for r in trends.calibration(p).collect()} == {9: (2, 0.5), 1: (1, 0.0)}
    drift = trends.card_drift(pairs(spark, [("a", 1, date(2024, 1, k), k) for k in (1, 3)], "label string, card_id long, date date, count int"))
    assert [r["change"] for r in drift.orderBy("date").collect()] == [None, 2.0]


@pytest.mark.parametrize("most", [0.0, 0.3, 0.6, 0.99])
def test_single_linkage_at_a_distance(spark, most):
    rng = random.Random(7)
    rows, decks = [], []
    for k in range(60):
        part = "ab"[k % 2]
        decks.append((part, k))
        cards = rng.sample(range(12), rng.randint(1, 4)) if k % 7 else []
        rows += [(part, k, c, 1 / len(cards) ** 0.5) for c in cards]
    found = clusters.linked_parts(spark.createDataFrame(rows, "slice string, deck_id long, card_id long, weight double"), spark.createDataFrame(decks, "slice string, deck_id long"), most, block=8)
    vector = {k: {c: w for _, j, c, w in rows if j == k} for _, k in decks}
    part = {k: k for _, k in decks}
    near = [(a, b) for p, a in decks for q, b in decks if p == q and a < b and round(1 - sum(w * vector[b].get(c, 0) for c, w in vector[a].items()), 12) <= most and vector[a].keys() & vector[b].keys()]
    for _ in decks:
        for a, b in near:
            part[a] = part[b] = min(part[a], part[b])
    assert {r["deck_id"]: r["part"] for r in found.collect()} == part


def test_decks_that_share_only_rare_cards_meet_in_no_cell(spark, monkeypatch):
    def fails(pdf):
        raise AssertionError("a cell")

    monkeypatch.setattr(clusters, "_first_edges", fails)
    decks = spark.range(4000).select(F.lit("s").alias("slice"), F.col("id").alias("deck_id"))
    cards = F.explode(F.array(F.col("deck_id") % 1000, 1000 + F.col("deck_id")))
    vecs = decks.select("slice", "deck_id", cards.alias("card_id"), F.lit(0.5**0.5).alias("weight"))
    found = clusters.tree_edges(vecs, decks, block=512)
    assert found.count() == 6000 and {r["d"] for r in found.select("d").distinct().collect()} == {0.5}
    assert clusters.linked_parts(vecs, decks, 0.7).where(F.col("part") != F.col("deck_id") % 1000).isEmpty()


def test_rare_and_frequent_cards_of_either_sign(spark):
    rng = np.random.default_rng(11)
    x = (rng.random((120, 80)) - 0.2) * (rng.random((120, 80)) < 0.03)
    x[::2, 0] = rng.random(60) - 0.5  # a card of every second deck
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows = [("s", i, c, float(x[i, c])) for i in range(120) for c in range(80) if x[i, c]]
    vecs = spark.createDataFrame(rows, "slice string, deck_id long, card_id long, weight double")
    decks = spark.createDataFrame([("s", i) for i in range(120)], "slice string, deck_id long")
    d = np.round(1 - x @ x.T, 12)
    near = {(i, j): d[i, j] for j in range(120) for i in range(j) if d[i, j] < 1}
    for block in (512, 16):
        found = {(r["a"], r["b"]): r["d"] for r in clusters.tree_edges(vecs, decks, block).collect()}
        assert all(near[k] == pytest.approx(v, abs=1e-11) for k, v in found.items()) and len(found) < len(near)
        tree = lambda edges: sum(w for w in sorted_kruskal(np.array([[edges.get((min(i, j), max(i, j)), 1.0) for j in range(120)] for i in range(120)])))
        assert tree(found) == pytest.approx(tree(near))
