"""Tries of conversations against a plain reading of their definition, and against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from deckloom.llm import prefix_trie as trie
from deckloom.llm.common import table

from ..compare import assert_same, database

SF = "/root/testdata/sf0.001"


def plain(rows, rebuild=True):
    """The nodes of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = dict(own)
    if rebuild:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), len(kids[x]), leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest())
        for x, m in members.items()
    )


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(*trie.COLUMNS).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def turns(spark, rows):
    return trie.encoded_turns(spark.createDataFrame(rows, SCHEMA))


def test_given_conversations(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.op13_prefix_trie(spark, SF)) == plain(rows)


@pytest.mark.parametrize("local, step", [(15, 64), (60, 2), (1 << 12, 64)])
def test_shared_beginnings(spark, monkeypatch, local, step):
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "STEP", step)
    rng = random.Random(local)
    rows = []
    for c in range(60):
        shared = ["hot"] * rng.choice([0, 1, 11, 12]) if c % 3 else ["hot"] * 12 + ["same", "end"] * (c % 2)
        for k, text in enumerate(shared + [rng.choice("ab") for _ in range(rng.randint(0, 4))]):
            rows.append((c * 3, k, "user", text * (1 + k % 3)))
    assert found(trie.prefix_trie(trie.sequences(turns(spark, rows)))) == plain(rows, rebuild=False)
    assert found(trie.prefix_trie(trie.rebuilt(trie.sequences(turns(spark, rows))))) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "", "x"), (100, 0, "user", "x"), (101, 5, "user", None), (101, 7, "use", "rx"), (None, 0, "user", "lost"),
        (250, 0, "user", "no first one"), (2**40, 0, "a", "🙂🙂"), (2**40 + 1, 0, "a", "🙂🙂"), (2**40 + 1, 1, "b", ""),
    ]
    assert found(trie.prefix_trie(trie.rebuilt(trie.sequences(turns(spark, rows))))) == plain(rows)
    assert found(trie.prefix_trie(trie.sequences(turns(spark, rows)))) == plain(rows, rebuild=False)
    assert found(trie.prefix_trie(trie.rebuilt(trie.sequences(turns(spark, rows[:0]))))) == []


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "LOCAL", 1000)
    rows = [(c, k, "user", "t" * (k % 5)) for c in (1, 2, 3) for k in range(900 + c * (c > 1))] + [(4, k, "user", "other") for k in range(5)]
    assert found(trie.prefix_trie(trie.sequences(turns(spark, rows)))) == plain(rows, rebuild=False)


def test_many_conversations_that_are_equal(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    monkeypatch.setattr(trie, "LOCAL", 8)
    rows = [(c * 5, k, "user", f"t{k}") for c in range(300) for k in range(3)] + [(7, 0, "user", "t0")]
    assert found(trie.prefix_trie(trie.sequences(turns(spark, rows)))) == plain(rows, rebuild=False)


def test_same_rows_as_sql(spark, monkeypatch):
    monkeypatch.setattr(trie, "LOCAL", 20)
    assert_same(trie.op13_prefix_trie(spark, SF), database(SF), trie.SQL["op13_prefix_trie"])
