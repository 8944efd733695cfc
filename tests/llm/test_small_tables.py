"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deckloom.llm import (
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    secrets,
    sentencepiece_codec,
    sharding,
    stages,
    toxicity,
    warc,
)

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [
    (1, "the cat sat on the mat\nand it was the best of mats in all the land", "en", "a", 10),
    (1, "the cat sat on the mat\nand it was the best of mats in all the land", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "le chat est sur la table et il dort bien", "fr", None, 3),
    (4, LONG, "en", "b", 5),
    (5, "the cat sat on the mat\nand it was the best of mats in all the land", "en", "b", 10),
    (6, "!!! 123 \n\n ...", "en", "b", 1),
    (7, 'password = "abcdefABCDEF123456"', "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = "n_lines n_deleted shard slot law ids n_ids score predicted lang_pred items spans n_words id k d t i text_hash _id _k _r _n _g _d _t _gone _lines _text kept assign".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "cat sat on the mat and it was the best of mats"), (2, None), (3, ""), (None, "le chat est sur la table et il dort bien"), (4, "short item")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (3, 1), (4, 0), (7, 1), (6, None), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def by_name(spark, benchmark, labels):
    def fit_language(docs):
        return language_id.predict_languages(docs, language_id.train(docs.where("lang is not null")))

    def fit_toxicity(docs):
        return toxicity.score_documents(docs, toxicity.train(docs, labels, "doc_id", "text", "toxic", toxicity.SAMPLE))

    def ledger(docs):
        from deckloom.llm.common import shared_dir

        import uuid

        return secrets.SecretLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").findings(docs)

    return {
        "sharding": sharding.interleave,
        "lines": line_dedup.dedup_lines,
        "decontamination": lambda d: decontamination.find_contamination(d, benchmark),
        "encode": sentencepiece_codec.encode_documents,
        "secrets": ledger,
        "toxicity": fit_toxicity,
        "language": fit_language,
        "near": ngram_join.similar_documents,
    }


NAMES = ["sharding", "lines", "decontamination", "encode", "secrets", "toxicity", "language", "near"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(docs, by_name, name):
    assert by_name[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(clashing, by_name, name):
    found = by_name[name](clashing)
    assert found.count() == len(ROWS) and len(found.columns) == len(set(found.columns))
    made = set(by_name[name](clashing.select("doc_id", "text", "lang", "source", "n_chars")).columns)
    rows = found.select(*[c for c in CLASHING if c in found.columns and c not in made] or [F.lit("mine")]).collect()
    assert all(set(r) == {"mine"} for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, by_name, name):
    found = by_name[name](docs.where("false"))
    assert found.count() == 0 and found.columns == by_name[name](docs).columns


@pytest.mark.parametrize("name", NAMES)
def test_nulls_only(spark, by_name, name):
    nothing = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    assert by_name[name](nothing).count() == 3


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, benchmark, tmp_path, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, docs, str(tmp_path))
    more = {"tokenize": ["ids", "n_ids", "round_trip"]}.get(name, [])
    assert found.columns == [*docs.columns, *more] and found.count() <= len(ROWS)
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_clashing_columns(spark, clashing, benchmark, tmp_path, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    more = ["n_runs", "round_trip", "decoded_crc32", "_row", "_words_of", "ball", "node", "own_score"]
    docs = clashing.select("*", *[F.lit("mine").alias(c) for c in more])
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, docs, str(tmp_path))
    last = ["ids", "n_ids", "round_trip"] if name == "tokenize" else []
    assert [c for c in found.columns if c not in last] == [c for c in docs.columns if c not in last]
    assert set(last) <= set(found.columns) and len(found.columns) == len(set(found.columns))
    mine = [c for c in [*CLASHING, *more] if c not in last]
    rows = found.select(*mine).collect()
    assert rows and all(set(r) == {"mine"} for r in rows)


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c d"), (7, "e f")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items, size=3).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 6)] and rows[1]["items"] == ["7"] and rows[2]["spans"] == []


def test_windows_of_very_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LISTED", 10)
    items = spark.createDataFrame([(k, "some words here") for k in range(95)], "item_id long, text string")
    windows = decontamination.item_windows(items, "item_id", "text", 3).collect()
    assert len(windows) > 5 and max(len(r["items"]) for r in windows) < 40
    docs = spark.createDataFrame([(1, "Some words, here!")], "doc_id long, text string")
    found = decontamination.find_contamination(docs, items, size=3, block_windows=3).first()
    assert found["items"] == sorted(str(k) for k in range(95)) and [tuple(s) for s in found["spans"]] == [(0, 3)]


def test_a_window_of_very_many_items_fills_no_block(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LISTED", 10)
    sizes = []
    real = decontamination._index
    monkeypatch.setattr(decontamination, "_index", lambda block, seen: sizes.append(len(block)) or real(block, seen))
    items = spark.createDataFrame([(k, "some words here") for k in range(900)], "item_id long, text string")
    found = decontamination.find_contamination(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), items, size=3, block_windows=15).first()
    assert found["items"] == sorted(str(k) for k in range(900))
    assert len(sizes) >= 5 and sum(sizes) >= 80 and max(sizes) < 40


def test_sources_of_one_row_and_rows_without_an_id_are_spread(spark):
    from pyspark.sql import Window as W

    n = 4000
    docs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("source"), (F.col("id") * 7).alias("size"))
    found = sharding.interleave(docs)
    assert [r["count"] for r in found.groupBy("shard").count().orderBy("shard").collect()] == [n // 8] * 8
    last = found.withColumn("r", F.row_number().over(W.partitionBy("shard").orderBy("slot")) - 1)
    assert last.where("r <> slot").count() == 0
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("size"))
    assert sharding.interleave(same).select("shard", "slot").distinct().count() == n


def test_ids_that_repeat_are_learned_from_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "nice words")] * 50 + [(2, "horrid words")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, shares, y, **k: seen.append((len(ids), sorted(y.tolist()))))
    toxicity.train(docs, labels, "doc_id", "text", "toxic", toxicity.SAMPLE)
    monkeypatch.setattr(toxicity, "ENTRIES", 1)
    toxicity.train(docs, labels, "doc_id", "text", "toxic", toxicity.SAMPLE)
    assert seen[0] == (2, [0, 1]) and seen[1][0] < 2


def test_near_copies_keep_one_of_each(spark, docs):
    kept = stages.without_near_copies(spark, docs, "").collect()
    texts = [r["text"] for r in kept]
    assert texts.count(ROWS[0][1]) == 1 and texts.count(None) == 1 and texts.count("") == 1 and LONG in texts
    assert {r["doc_id"] for r in kept} == {1, 2, 3, None, 4, 6, 7}


def test_pages(spark):
    rows = [(3, "http://B.example/x", "same"), (2, None, "same"), (5, "http://b.example", None), (6, "http://[bad", ""), (None, "u", "other"), (None, "u", "other"), (2, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    from deckloom.llm.common import shared_dir

    import uuid

    found = warc.archive_pages(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found if r["page_id"] is not None)
    assert got == [(2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 2, 4), (5, "response", None, 0), (6, "revisit", 5, 0)]
    assert [r["record_type"] for r in found if r["page_id"] is None] == ["response"] * 2
    order = [(r["url_key"], r["captured_at"]) for r in found]
    assert order == sorted(order)
    empty = warc.archive_pages(pages.where("false"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    assert empty.count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (8, []), (1, [1.0, 0.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("k", F.lit(1)))
    got = sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in found.collect())
    assert got == [(-1, 0, True), (1, 2, True), (1, 2, True), (2, 2, False), (3, 0, True), (4, 0, True), (5, 0, True), (6, 0, True), (7, 0, True), (8, 0, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_copies_are_missed_as_seldom_as_stated():
    # Pairs at the threshold, agreeing in a random number of tokens, all of whose nodes are large down to DEPTH.
    import numpy as np

    share = np.random.default_rng(1).binomial(ngram_join.SIZE, 0.8, 400_000) / ngram_join.SIZE
    lost = np.zeros_like(share)
    for _ in range(ngram_join.DEPTH):
        gone = 1 - share * (1 - lost)
        lost = 0.75 * gone + 0.25 * gone * gone
    miss = (lost ** ngram_join.runs_for(ngram_join.RECALL, 0.8)).mean()
    assert miss < 1 - ngram_join.RECALL
    least = ngram_join.least_agreeing(ngram_join.RECALL, 0.8)
    assert (share * ngram_join.SIZE < least).mean() < 1 - ngram_join.RECALL
    assert ngram_join.missed(ngram_join.runs_for(ngram_join.RECALL, 0.8), least, 0.8) <= 1 - ngram_join.RECALL


def test_every_label_is_learned(spark):
    # The 101st label and those after it, by frequency, were left out.
    rows = [(200 * n + k, f"{chr(0x4E00 + 7 * n)}{chr(0x5E00 + 11 * n)} " * 5, f"x{n:03d}") for n in range(105) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predict_languages(docs, language_id.train(docs))
    assert found.select("lang_pred").distinct().count() > 100
    assert {v for v, *_ in language_id.routes([f"x{n}" for n in range(400)])} == {f"x{n}" for n in range(400)}
