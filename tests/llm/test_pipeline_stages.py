"""The pipeline's stages one after the other, each against the ids and texts that a plain reading of its rule gives."""

from __future__ import annotations

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from deckloom.llm import language_id, ngrams
from deckloom.llm.sentencepiece_codec import MODEL

from .test_results import documents, words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ITEM = "w1 w7 w13 w19 w25 w31 w37 w43 w49 w55 w2"


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12345 !!! 67")], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]])
    kept = {r["doc_id"] for r in STAGES["language_id"](spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    model = language_id.train(docs.where(~ngrams.held("doc_id", 5, 0)))
    clear = {r["doc_id"] for r in language_id.predict_languages(docs, model).where(f"score >= {language_id.CLEAR} and lang_pred <> 'und'").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == clear & lettered and len(kept) >= 0.95 * len(lettered)


@pytest.fixture(scope="module")
def start():
    rng = random.Random(11)
    rows = documents(5)
    vocabulary = [f"w{k}" for k in range(60)]
    for k in range(200, 206):
        base = rng.choices(vocabulary, k=120)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:60], "other", *base[60:]]))]
    rows += [(900, f"before {ITEM} after"), (901, "W1, w7; w13 w19 w25 w31 w37 w43 w49 w55!"), (902, "w1 w7 w13 w19 w25 w31"), (903, "!!!"), (904, "!!!"), (905, "???")]
    return rows


def without_repeated_runs(rows, least=5):
    seen, out = set(), []
    for k, text in sorted(rows):
        split = text.split("\n")
        lines = [(n, x) for n, x in enumerate(split) if x.strip()]
        gone, found = set(), []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone |= {n for n, _ in lines[i:j]}
                    # Earlier places of this document count from the next start on.
                    found.append(run)
            seen.update(found)
            found = []
        out.append((k, "\n".join(x for n, x in enumerate(split) if n not in gone)))
    return out


def without_near_copies(rows):
    def grams(text):
        w = words(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {k: grams(t) for k, t in rows}
    part = {k: k for k, _ in rows}
    near = [(a, b) for a in part for b in part if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    for _ in rows:
        for a, b in near:
            part[a] = part[b] = min(part[a], part[b])
    first = {}
    for k, t in sorted(rows):
        if not sets[k]:
            first.setdefault(t, k)
    return [(k, t) for k, t in rows if (part[k] == k if sets[k] else first[t] == k)]


def without_items(rows, items):
    windows = {tuple(v[s : s + 10]) for v in map(words, items) for s in range(max(1, len(v) - 9)) if v}

    def hit(text):
        w = words(text)
        return any(tuple(w[p : p + len(x)]) == x for x in windows for p in range(len(w) - len(x) + 1))

    return [(k, t) for k, t in rows if not hit(t)]


def test_stages_in_order(spark, start, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, ITEM), (2, "never seen words stand here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in start], schema)

    def run(name):
        nonlocal docs
        path = f"{sf}/{name}"
        STAGES[name](spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        return sorted((r["doc_id"], r["text"]) for r in docs.collect())

    want = without_repeated_runs(start)
    assert run("line_dedup") == want and want != sorted(start)
    assert docs.where("n_chars <> length(text)").count() == 0
    fewer = without_near_copies(want)
    assert run("ngram_join") == sorted(fewer) and len(fewer) < len(want)
    assert {401, 411}.isdisjoint(k for k, _ in fewer) and {400, 410, 903, 905} <= {k for k, _ in fewer}
    clean = without_items(fewer, [ITEM, "never seen words stand here"])
    assert run("decontamination") == sorted(clean) and {k for k, _ in fewer} - {k for k, _ in clean} == {900, 901}
    assert run("tokenize") == sorted(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {k: library.encode(t) for k, t in clean}
    assert docs.where("not round_trip or n_ids <> size(ids)").count() == 0
