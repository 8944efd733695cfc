"""Fingerprints against sets of word 5-grams and a plain reading of the edited texts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom.llm import fingerprints as prints
from deckloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(id, text, its edited text, the next text), the rows in order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        yield k, text, text[: len(text) - half] + after[:half], after


def test_given_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in prints.op12_fingerprints(spark, SF).collect()}
    assert len(found) == len(rows)
    errors, by_text = [], {}
    for k, text, new, after in edited(rows):
        r = found[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        for score, other in (("near_edited", new), ("near_next", after)):
            want = jaccard(text, other)
            errors.append(abs(r[score] - want))
            if len(grams(text) | grams(other)) <= prints.K:
                assert r[score] == want
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["edited_fingerprint"] == prints.written(prints.sketch(new))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.02
    assert len(set(by_text.values())) > len(by_text) * 0.9


@pytest.mark.parametrize("partitions", [1, 3])
def test_odd_rows(spark, partitions):
    texts = [None, "", "one", "two words", "!!!", "ein Wort mit ümlaut ist hier 🙂🙂 und da", "a b c d e f g " * 3, "x" * 5000]
    rows = [(k * 7 - 9, t) for k, t in enumerate(texts)] + [(None, "no id"), (2**62, "large"), (-(2**63), "least id of all")]
    found = {r["doc_id"]: r for r in prints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()}
    for k, text, new, after in edited(rows):
        r = found[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (jaccard(text, new), jaccard(text, after))
        assert r["n_shingles"] == len(grams(text))


def test_small_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, "x")], "doc_id long, text string").withColumn("fingerprint", F.lit("mine"))
    assert prints.fingerprint_edits(docs).count() == 4
    assert prints.fingerprint_edits(docs.limit(0)).count() == 0
    one = prints.fingerprint_edits(docs.where("text = 'x'")).collect()
    assert [(r["near_next"], r["near_edited"]) for r in one] == [(1.0, 1.0)]
    kept = prints.fingerprint_documents(docs)
    assert sorted(kept.columns) == ["doc_id", "fingerprint", "n_shingles", "text"] and kept.where("fingerprint = ''").count() == 1


def test_rows_of_one_id_spread_over_parts(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sizes = [r["count"] for r in prints.in_order(docs, "doc_id", "text").where("head = 0").groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500


def test_groups_merge_to_the_sketch_of_all_their_texts(spark, monkeypatch):
    monkeypatch.setattr(prints, "MERGED", 3)
    rng = random.Random(4)
    rows = [(f"g{k % 5}" if k % 3 else "hot", " ".join(rng.choices("abcdefghij", k=rng.randint(0, 60)))) for k in range(300)] + [(None, "some words without a group here"), ("hot", None)]
    docs = spark.createDataFrame(rows, "source string, text string").repartition(7)
    found = {r["source"]: r for r in prints.merge_fingerprints(prints.fingerprint_documents(docs), "source").collect()}
    assert set(found) == {s for s, _ in rows}
    for source, r in found.items():
        hashes = np.unique(np.concatenate([prints.shingles((t or "").encode()) for s, t in rows if s == source]))
        assert r["fingerprint"] == prints.written(hashes[: prints.K])
        n = len(set().union(*[grams(t) for s, t in rows if s == source]))
        assert len(hashes) == n and abs(r["n_shingles"] - n) <= 0.3 * n
    assert prints.merge_fingerprints(prints.fingerprint_documents(docs.limit(0)), "source").count() == 0


def test_parts_of_a_text(spark):
    words = [f"w{k * k % 7919}" for k in range(3000)]
    parts = [" ".join(words[max(0, a - 4) : a + 500]) for a in range(0, 3000, 500)]
    whole = prints.sketch(" ".join(words))
    now = prints.sketch(None)
    for part in random.Random(1).sample(parts, len(parts)):
        now = prints.merged(now, prints.sketch(part))
    assert (now == whole).all()


@pytest.mark.parametrize("shared", [0, 200, 1000, 2000])
def test_estimates(spark, shared):
    a = " ".join(f"a{k}" for k in range(2000))
    b = " ".join([f"a{k}" for k in range(2000 - shared, 2000)] + [f"b{k}" for k in range(4000 - shared)])
    rows = spark.createDataFrame([(prints.written(prints.sketch(a)), prints.written(prints.sketch(b)), 1)], "l string, r string, contains int")
    found = prints.compare_fingerprints(rows, "l", "r").first()
    both = len(grams(a) & grams(b))
    assert abs(found["resemblance"] - jaccard(a, b)) < 0.12
    assert abs(found["contained"] - both / len(grams(a))) < 0.3 and abs(found["contains"] - both / len(grams(b))) < 0.2
