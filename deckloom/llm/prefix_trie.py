"""Operator 13: the trie of all conversations' prefixes, with what sharing them saves.

Each distinct turn (role and text) gets a number, so that a conversation is a row of
numbers. Equal conversations are collapsed to one row with their count. A radix sort from the
most significant place on then deals the rows into buckets by their first number, their
second one, and so on, all buckets of a depth in one job: a bucket with more than
``LOCAL`` turns whose rows differ is dealt on, any other one is finished by a single
task. There a multikey quicksort parts the rows at one place after another into
smaller, equal and larger ones; each equal part is a node, which it emits as it goes down.
Where all rows of a large bucket go on alike, it takes up to ``STEP`` places at once.

Sums over subtrees come up from the finished buckets to the few large nodes above
them, one depth at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, groups, table

#: Turns of a bucket that one task finishes; places that a large bucket whose rows are alike takes at once.
LOCAL, STEP = 1 << 12, 64
#: Bytes of bucket keys that are sent to all tasks, at most.
SENT = 32 << 20
#: Conversations that share a first part are those of one hundred; conversation ids in a chunk of a node's list.
GROUP, PREFIXES, CHUNK = 100, 6, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, n): the turns of each conversation in order, from place 0, as numbers of a dictionary, with their code points.

    Turns are told apart by 128 bits of hashes of role and text; texts are not shuffled. A null role or
    text is an empty one. Turns are ordered by turn, nulls first, then by those hashes. Rows without a conv_id go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps role and text apart.
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.length(text).cast("long").alias("n"),
        F.xxhash64(F.length(role), role, text).alias("h1"), F.xxhash64(text, F.lit(11), role, F.length(role)).alias("h2"),
    )
    rows = cut(rows.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")) - 1).drop("turn"))
    dictionary = numbered(rows.groupBy("h1", "h2").agg(F.max("n").alias("n")), ["h1", "h2"])
    return rows.drop("n").join(dictionary, ["h1", "h2"]).select("conv_id", "pos", "id", "n")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, ns): each conversation's numbers in order and their code points, as arrays. turns: conv_id, pos, id, n."""
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "n"))).alias("t"))
    return packed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.n").alias("ns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that share first turns with the first one of their hundred.

    A conversation's first h turns are replaced by the first h ones of conversation conv_id -
    conv_id % 100, or as many as that has; h is the CRC-32 of its decimal id, modulo 6. The remainder has the
    sign of the id. The result may have no turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIXES).cast("int")
    first = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, PREFIXES - 1).alias(f"first_{c}") for c in ("ids", "ns")])
    joined = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left")

    def both(c: str) -> Column:
        none = F.array().cast("array<bigint>")
        before = F.slice(F.coalesce(f"first_{c}", none), F.lit(1), F.col("h"))
        return F.concat(before, F.slice(F.col(c), F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))

    return joined.select("conv_id", both("ids").alias("ids"), both("ns").alias("ns"))


def _ends(convs: DataFrame) -> DataFrame:
    """(g1, g2, ends): for each sequence the hash of its conversations' ids in order. convs: conv_id, g1, g2.

    Ids are distinct, so a chunk of a range of ids is bounded; chunks are hashed one after the other, and none is held but one.
    """
    chunks = convs.groupBy("g1", "g2", F.floor(F.col("conv_id") / CHUNK).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2", "at").select("g1", "g2", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (a, b) == last:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((*last, digest.hexdigest()))
                    last, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            yield packed(done)
        if digest:
            yield packed([(*last, digest.hexdigest())])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["g1", "g2", "ends"])

    return dealt.mapInArrow(run, "g1 long, g2 long, ends string")


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(ids, ns, convs, conv_id, ends): equal sequences once, with how many conversations have them, the least id, and the hash of all ids."""
    keyed = cut(convs.withColumns({"g1": F.xxhash64("ids"), "g2": F.xxhash64(F.lit(5), F.size("ids"), "ids")}))
    ends = _ends(keyed.select("conv_id", "g1", "g2"))
    once = keyed.groupBy("g1", "g2", "ids", "ns").agg(F.count("*").alias("convs"), F.min("conv_id").alias("conv_id"))
    return once.join(ends, ["g1", "g2"]).select("ids", "ns", "convs", "conv_id", "ends")


def finish(depth: int, path: int | None, rows: list[tuple[list[int], list[int], int, int, str]]) -> tuple[list, ...]:
    """The nodes of a bucket from its top one down, by a multikey quicksort.

    rows: (ids, code points, conversations, least conv_id, hash of ids) of distinct sequences that agree in their first
    ``depth`` places. Returns the columns of a node, the top node first. path: conv_id of the node above.
    """
    conv, at, above, n, kids, own, ends, up = ([] for _ in range(8))

    def node(members: list, d: int, over: int) -> int:
        conv.append(min(m[3] for m in members))
        at.append(d)
        above.append(path if over < 0 else conv[over])
        n.append(sum(m[2] for m in members))
        kids.append(0)
        own.append((n[-1] - 1) * (members[0][1][d - 1] if d else 0))
        ends.append(next((m[4] for m in members if len(m[0]) == d), EMPTY))
        up.append(over)
        if over >= 0:
            kids[over] += 1
        return len(conv) - 1

    def chain(m: tuple, d: int, over: int) -> None:
        """The rest of a single sequence, from depth d on."""
        size, first = len(m[0]), len(conv)
        more = size - d + 1
        conv.extend([m[3]] * more)
        at.extend(range(d, size + 1))
        above.extend([path if over < 0 else conv[over], *[m[3]] * (more - 1)])
        n.extend([m[2]] * more)
        kids.extend([1] * (more - 1) + [0])
        own.extend([(m[2] - 1) * x for x in m[1][d - 1 :]] if d else [0, *((m[2] - 1) * x for x in m[1])])
        ends.extend([EMPTY] * (more - 1) + [m[4]])
        up.extend([over, *range(first, first + more - 1)])
        if over >= 0:
            kids[over] += 1

    todo: list[tuple] = [(True, rows, depth, -1)]
    while todo:
        is_node, members, d, over = todo.pop()
        if not members:
            continue
        if is_node and len(members) == 1:
            chain(members[0], d, over)
        elif is_node:
            k = node(members, d, over)
            todo.append((False, [m for m in members if len(m[0]) > d], d, k))
        else:
            pivot = members[len(members) // 2][0][d]
            less, equal, more_ = [], [], []
            for m in members:
                x = m[0][d]
                (less if x < pivot else more_ if x > pivot else equal).append(m)
            todo += [(False, more_, d, over), (False, less, d, over), (True, equal, d + 1, over)]
    # Nodes come after the node above them, so sums go up from the last one on.
    leaves, saved = [0] * len(conv), own
    for k in range(len(conv) - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    return conv, at, above, n, kids, leaves, saved, ends


def _finished(local: DataFrame) -> DataFrame:
    """The nodes of all finished buckets, with their bucket's key and whether they are its top. local: k1, k2, depth, above, ids, ns, convs, conv_id, ends."""
    n = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = local.select("k1", "k2", "depth", "above", "ids", "ns", "convs", "conv_id", "ends").repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2")
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [*COLUMNS, "k1", "k2", "top"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for bucket in groups(batches, ["k1", "k2"]):
            k1, k2, depth, above = (bucket.column(c)[0].as_py() for c in range(4))
            found = finish(depth, above, list(zip(*(bucket.column(c).to_pylist() for c in range(4, 9)))))
            size = len(found[0])
            for mine, theirs in zip(held, (*found, [k1] * size, [k2] * size, [True] + [False] * (size - 1))):
                mine.extend(theirs)
            if len(held[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names)
                held = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names)

    return dealt.mapInArrow(run, f"{NODE}, k1 long, k2 long, top boolean")


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Keys of n buckets, sent to all tasks if they are few."""
    return F.broadcast(rows) if n * 40 <= SENT else rows


def _dealt(active: DataFrame, buckets: int) -> DataFrame:
    """``active`` with step, how many places its bucket takes now, and the key (c1, c2) and depth (to) of the row's next bucket.

    A bucket takes more than one place if no row ends before and all agree; of the nodes
    in between, ``least`` is the conv_id.
    """
    steps = [1 << k for k in range(1, STEP.bit_length())]
    part = lambda j: F.slice("ids", F.col("depth") + 1, F.lit(j))
    marks = [f(F.xxhash64(F.lit(seed), part(j))).alias(f"{name}{seed}_{j}") for j in steps for seed in (1, 2) for name, f in (("low", F.min), ("high", F.max))]
    alike = lambda j: (F.col("room") >= j) & (F.col(f"low1_{j}") == F.col(f"high1_{j}")) & (F.col(f"low2_{j}") == F.col(f"high2_{j}"))
    stats = active.groupBy("k1", "k2").agg(F.min(F.size("ids") - F.col("depth")).alias("room"), F.min("conv_id").alias("least"), *marks)
    stats = stats.select("k1", "k2", "least", F.greatest(F.lit(1), F.lit(1), *[F.when(alike(j), j).otherwise(1) for j in steps]).alias("step"))
    taken = F.slice("ids", F.col("depth") + 1, F.col("step"))
    return active.join(_small(stats, buckets), ["k1", "k2"]).withColumns(
        {"c1": F.xxhash64("k1", taken), "c2": F.xxhash64("k2", F.lit(3), taken), "to": F.col("depth") + F.col("step")}
    )


def _next_buckets(dealt: DataFrame) -> DataFrame:
    """A row for each next bucket: its key, that of the bucket before, conv_id, conversations, turns and rows left, and code points of its last turn."""
    found = dealt.groupBy("c1", "c2", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("convs").alias("n_convs"), F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("to")).alias("turns"),
        F.max(F.element_at("ns", F.col("to"))).alias("own"), F.max("to").alias("depth"), F.max("step").alias("step"), F.max("above").alias("above"),
    )
    return found.withColumn("large", (F.col("turns") > LOCAL) & (F.col("rows") > 1))


def _passed(dealt: DataFrame, kids: DataFrame) -> DataFrame:
    """``kids`` with the code points of the nodes between a bucket and the one before, which its first conversation tells."""
    between = dealt.where("step > 1").join(kids.where("step > 1").select("c1", "c2", "conv_id"), ["c1", "c2", "conv_id"])
    between = between.select("c1", "c2", F.slice("ns", F.col("depth") + 1, F.col("step") - 1).alias("between"))
    return kids.join(between, ["c1", "c2"], "left")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each distinct beginning of a conversation, from the empty one on: a node of the trie.

    convs: conv_id (distinct), ids and ns, arrays of turn numbers and their code points (``sequences``).
    Returns, as long, conv_id, the smallest of a node's conversations; depth; parent_conv_id (of the
    root: null); n_convs; n_children; n_leaves, nodes without children in its subtree, itself included;
    saved_tokens, the sum over its subtree of (n_convs - 1) times the code points of a node's last
    turn; and ends_sha256, the SHA-256 of the ids, in order and joined by commas, of conversations that end here.

    Without conversations there is no node. A conversation's numbers are one row, and a bucket of one sequence
    is finished by one task, however long it is. The driver sees a count for each round.
    """
    seqs = cut(distinct_sequences(convs)).withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "depth": F.lit(0), "above": F.lit(None).cast("long")})
    total = seqs.agg(F.min("conv_id"), F.sum("convs"), F.sum(F.size("ids")), F.count("*"), F.min(F.when(F.size("ids") == 0, F.col("ends")))).first()
    if (total[2] or 0) <= LOCAL or total[3] == 1:
        return _finished(seqs).select(*COLUMNS)
    key, own = ["k1", "k2"], ["ids", "ns", "convs", "conv_id", "ends"]
    active = seqs.where(F.size("ids") > 0).withColumn("above", F.lit(total[0]).cast("long"))
    local, levels, ended, buckets = [], [], [], 1
    while buckets:
        dealt = cut(_dealt(active, buckets))
        kids = cut(_next_buckets(dealt))
        levels.append(_passed(dealt, kids))
        buckets = kids.where("large").count()
        renamed = [F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("to").alias("depth")]
        above = F.when(F.col("step") > 1, F.col("least")).otherwise(F.col("above")).alias("above")
        if not buckets:
            local.append(dealt.select(*renamed, above, *own))
            break
        held = _small(kids.where("large").select("c1", "c2", F.col("conv_id").alias("node")), buckets)
        local.append(dealt.join(held, ["c1", "c2"], "left_anti").select(*renamed, above, *own))
        on = dealt.join(held, ["c1", "c2"]).select(*renamed, F.col("node").alias("above"), *own)
        ended.append(on.where("size(ids) = depth").select(*key, F.col("ends").alias("ends_sha256")))
        active = on.where("size(ids) > depth")
    every = local[0]
    for more in local[1:]:
        every = every.unionByName(more)
    finished = cut(_finished(every))
    sums = finished.where("top").select("k1", "k2", "n_leaves", "saved_tokens", F.lit(0).cast("long").alias("n_children"))
    nodes, below = [finished.select(*COLUMNS)], None
    for depth in range(len(levels) - 1, -1, -1):
        at = sums if below is None else sums.unionByName(below)
        kids = levels[depth].withColumnsRenamed({"k1": "p1", "k2": "p2", "c1": "k1", "c2": "k2"}).join(at, key)
        # Of a large bucket's node the sums so far are those of its subtree without itself.
        saved = F.col("saved_tokens") + F.when(F.col("large"), (F.col("n_convs") - 1) * F.col("own")).otherwise(0)
        kids = cut(kids.withColumn("saved_tokens", saved))
        parent = F.when(F.col("step") > 1, F.col("conv_id")).otherwise(F.col("above"))
        if depth < len(ended):
            tops = kids.where("large").join(ended[depth], key, "left")
            nodes.append(tops.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
        nodes.append(_between(kids))
        lost = F.when(F.col("step") > 1, (F.col("n_convs") - 1) * F.aggregate(F.coalesce("between", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)
        below = kids.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum(F.col("saved_tokens") + lost).alias("saved_tokens"), F.count("*").alias("n_children")
        )
    nodes.append(below.select(F.lit(total[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total[1]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(total[4] or EMPTY).alias("ends_sha256")))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more.select(*COLUMNS))
    return out


def _between(kids: DataFrame) -> DataFrame:
    """The nodes that a bucket of several places passed: each has one child, and the conversations of the last one."""
    rows = kids.where("step > 1").select("*", F.posexplode("between").alias("i", "_n"))
    # The code points of the places from this one to the last but one are those of the nodes below that are passed, too.
    rest = F.aggregate(F.slice("between", F.col("i") + 1, F.size("between") - F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "conv_id", (F.col("depth") - F.col("step") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"), F.lit(EMPTY).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(encoded_turns(table(spark, sf_dir, "conversations")))))


SQL = {
    "op13_prefix_trie": """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
own AS (
  SELECT conv_id, list({r: coalesce(role, ''), x: coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
    lambda c, z: xor(c >> 8, t.crc[xor(c & 255, z) + 1])), 4294967295) % 6 AS h
  FROM own, t),
built AS (
  SELECT h.conv_id, list_concat(coalesce(b.s, [])[:h.h], h.s[h.h + 1:]) AS s
  FROM h LEFT JOIN own AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
place AS (SELECT conv_id, len(s) AS size, s, unnest(range(len(s) + 1)) AS depth FROM built),
prefix AS (
  SELECT conv_id, size, depth, CASE WHEN depth = 0 THEN '' ELSE sha256(CAST(to_json(s[:depth]) AS VARCHAR)) END AS k, CASE WHEN depth = 0 THEN 0 ELSE length(s[depth].x) END AS n
  FROM place),
node AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
  FROM prefix GROUP BY depth, k),
edge AS (
  SELECT c.depth, c.k, p.k AS up, q.conv_id AS up_conv
  FROM node AS c JOIN prefix AS p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 JOIN node AS q ON q.depth = p.depth AND q.k = p.k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM edge GROUP BY 1, 2),
tree AS (
  SELECT p.depth, p.k, count(CASE WHEN kids.n IS NULL THEN 1 END) AS leaves, sum((c.n_convs - 1) * c.n) AS saved
  FROM node AS c JOIN prefix AS p ON p.conv_id = c.conv_id AND p.depth <= c.depth LEFT JOIN kids ON kids.depth = c.depth AND kids.k = c.k
  GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up_conv AS parent_conv_id, n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM node JOIN tree ON tree.depth = node.depth AND tree.k = node.k LEFT JOIN edge ON edge.depth = node.depth AND edge.k = node.k
LEFT JOIN kids ON kids.depth = node.depth AND kids.k = node.k
""",
}
