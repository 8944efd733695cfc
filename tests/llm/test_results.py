"""Results against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from deckloom.llm import (
    common,
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    queries,
    secrets,
    sharding,
    stages,
    toxicity,
    warc,
)
from deckloom.llm import sentencepiece_codec as codec
from deckloom.llm.common import shared_dir

from ..compare import assert_same, database

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), database(SF), queries.SQL[name])


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def documents(seed, n=120):
    """Small documents with copies, near copies and repeated lines."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(40)] + [""]
    out = []
    for k in range(n):
        text = "\n".join(rng.choices(lines, k=rng.randint(1, 8)))
        if k and rng.random() < 0.3:
            text = rng.choice(out)[1]
            if rng.random() < 0.7:
                text = text + " " + rng.choice(vocabulary)
        out.append((k, text))
    return out


@pytest.mark.parametrize("n_rows, n_shards", [(0, 3), (1, 3), (50, 4), (97, 8)])
def test_shards(spark, n_rows, n_shards):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"s{k % 7}") for k in range(n_rows)], "doc_id long, source string")
    found = sharding.interleave(rows, n_shards).collect()
    sizes = [sorted(r["slot"] for r in found if r["shard"] == k) for k in range(n_shards)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    sources = [r["source"] for r in found]
    for source in set(sources):
        share = [sum(r["source"] == source for r in found if r["shard"] == k) for k in range(n_shards)]
        assert max(abs(n - sources.count(source) / n_shards) for n in share) <= len(set(sources))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("least", [3, 5, 9])
def test_line_dedup(spark, seed, least):
    docs = documents(seed)
    seen, gone = {}, {k: set() for k, _ in docs}
    split = {k: [x for x in enumerate(t.split("\n")) if x[1].strip()] for k, t in docs}
    runs = [(k, i, j) for k, _ in docs for i in range(len(split[k])) for j in range(i + 1, len(split[k]) + 1)]
    for k, i, j in sorted(runs, key=lambda r: (r[0], r[1])):
        run = tuple(x[1] for x in split[k][i:j])
        if sum(len(x.split()) for x in run) >= least:
            if run in seen:
                gone[k] |= {x[0] for x in split[k][i:j]}
            seen.setdefault(run, (k, i))
    want = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in docs}
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_repeated_runs(spark, seed):
    docs = documents(seed, 60)
    lines = {k: [x for x in t.split("\n") if x.strip()] for k, t in docs}
    places = [(k, i) for k in sorted(lines) for i in range(len(lines[k]))]

    def common(p, q):
        a, b = lines[p[0]][p[1] :], lines[q[0]][q[1] :]
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for n, p in enumerate(places):
        # The deepest power of two at which p has an earlier copy, the first of all copies there, how many there are.
        most = max((common(p, q) for q in places[:n]), default=0)
        if most:
            depth = 1 << (most.bit_length() - 1)
            alike = [q for q in places if common(p, q) >= depth]
            want[p] = (common(p, alike[0]), alike[0], len(alike))
    kept = {p: v for p, v in want.items() if want.get((p[0], p[1] - 1), (0, None))[1] != (v[1][0], v[1][1] - 1)}
    found = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["d"], r["i"]): (r["lines"], (r["first"]["d"], r["first"]["i"]), r["copies"]) for r in found} == kept


def test_decontamination(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices(["a", "b", "c", "D"], k=rng.randint(0, 60)))) for k in range(80)]
    items = [(k, " ".join(rng.choices(["a", "b", "c"], k=rng.choice([3, 5, 6, 9])))) for k in range(12)]
    found = decontamination.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=5, block_windows=7
    )
    for r in found.collect():
        w, hit, ids = words(dict(docs)[r["doc_id"]]), set(), set()
        for item, text in items:
            v = words(text)
            for s in range(max(1, len(v) - 4)):
                window = v[s : s + 5]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        ids.add(str(item))
        assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit and r["items"] == sorted(ids) and r["n_words"] == len(w)


def fresh_ids(pieces, text):
    return np.frombuffer(codec.encode_texts(pieces, [text])[0], dtype=np.int32).tolist()


@pytest.fixture(scope="module")
def pieces():
    return codec.Pieces.load(codec.MODEL)


def test_same_ids_as_the_library(spark, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choices("aeintr s  lod' xйéя1.-\n\t日", k=rng.randint(1, 90))) for _ in range(300)]
    texts += ["a" * 3000, " " * 700, "thethe" * 400, "日本語" * 300, "\n" * 50, "", " ", "x\0y"]
    assert [fresh_ids(pieces, t) for t in texts] == model.encode(texts)


def test_long_stretches_stream(pieces):
    text = "▁" + "aninternationalization" * 300
    stream = codec.viterbi(pieces, text)
    first = next(stream)
    assert [first, *stream] == fresh_ids(pieces, text[1:])


def test_unigram_models_maximize_the_score(pieces):
    from sentencepiece import sentencepiece_model_pb2

    with open(codec.MODEL, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    unigram = codec.Pieces.of(proto)

    def brute(s):
        best = {0: 0.0}
        for end in range(1, len(s) + 1):
            ways = [best[a] + unigram.score[s[a:end]][0] for a in range(end) if s[a:end] in unigram.score]
            if s[end - 1 : end] not in unigram.score:
                ways.append(best[end - 1] + unigram.unknown)
            best[end] = max(ways)
        return best[len(s)]

    rng = random.Random(3)
    words_ = ["the", "international", "▁▁▁the▁cat", *("".join(rng.choices("▁aeinrst", k=rng.randint(1, 40))) for _ in range(200))]
    for word in words_:
        ids = list(codec.viterbi(unigram, word))
        assert sum(unigram.score[unigram.name[k]][0] for k in ids) == pytest.approx(brute(word), abs=1e-6)
        assert "".join(unigram.name[k] for k in ids) == word
    # Characters without a piece, side by side and streamed.
    for word in ("▁zzz語éx", "語" * 60):
        want = list(codec.viterbi(unigram, word))
        assert np.frombuffer(codec.abreast(unigram, [word])[0], dtype=np.int32).tolist() == want
        assert b"".join(unigram.text[k] for k in want).decode() == word.replace("▁", " ")


def test_memory_of_stretches_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(codec, "MEMO", 50)
    monkeypatch.setattr(codec, "LOOKED_UP", 64)
    monkeypatch.setattr(codec, "PORTION", 100)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh  \n▁", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    model = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    small = codec.Pieces.load(codec.MODEL)
    for text, ids in zip(texts, codec.encode_texts(small, texts)):
        found = np.frombuffer(ids, dtype=np.int32)
        assert "▁" in text or found.tolist() == model.encode(text)
        assert codec.decode(small, pa.array([found], pa.list_(pa.int32()))) == [text.encode()]
    assert len(small.memo) <= 50 + 64 and len(small.older) <= 50 + 64


def test_round_trip(spark):
    rows = queries.QUERIES["op4_sentencepiece"](spark, SF)
    assert rows.where("not round_trip").count() == 0 and rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    odd = spark.createDataFrame([(1, "a▁b  \u0000 é\r\n"), (2, ""), (3, None)], "doc_id long, text string")
    both = codec.decode_documents(codec.encode_documents(odd))
    assert both.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
    checked = {r["doc_id"]: (r["n_ids"], r["round_trip"], r["decoded_crc32"]) for r in codec.round_trip_documents(odd).collect()}
    want = {r["doc_id"]: (r["n_ids"], True, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in both.collect()}
    assert checked == want


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.SecretLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(1, "AKIA" + "A" * 20), (2, "x"), (3, "x")], "doc_id long, text string")
    assert ledger.scan(docs).count() == 6
    assert ledger.scan(docs).count() == 0
    more = docs.unionByName(spark.createDataFrame([(4, "token: abcdefghijkl")], "doc_id long, text string"))
    assert ledger.scan(more).count() == 3
    newer = tuple(secrets.Rule(r.name, 2, r.pattern, r.group, r.least) if r.name == "hex" else r for r in secrets.RULES)
    assert ledger.scan(more, rules=newer).count() == 3
    found = {r["doc_id"]: len(r["access"]) + len(r["assign"]) for r in ledger.findings(more).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 1}
    # Opened again, it knows all that; a batch without its mark counts for nothing.
    again = secrets.SecretLedger(spark, ledger.path)
    assert again.scan(more, rules=newer).count() == 0
    fifth = spark.createDataFrame([(5, "AKIA" + "B" * 20)], "doc_id long, text string")
    ledger.known().write.parquet(f"{ledger.path}/batch-unfinished")
    common.remove(spark, f"{ledger.path}/batch-unfinished/_SUCCESS")
    assert secrets.SecretLedger(spark, ledger.path).scan(more.unionByName(fifth)).count() == 3


def test_secrets_of_old_versions(spark):
    key, other = "AKIA" + "A" * 20, "AKIA" + "B" * 20
    rows = [("a", 1, f"x {key}"), ("a", 2, f"y {key} {other}"), ("a", 3, "clean"), ("b", 1, f"x {key}"), ("c", None, None), (None, 1, other)]
    history = spark.createDataFrame(rows, "path string, version int, text string")
    ledger = secrets.SecretLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {(r["path"], r["secret_sha256"]): (r["first_version"], r["last_version"], r["versions"]) for r in ledger.exposures(history).collect()}
    assert found == {("a", sha(key)): (1, 2, 2), ("a", sha(other)): (2, 2, 1), ("b", sha(key)): (1, 1, 1), (None, sha(other)): (1, 1, 1)}


def test_secret_spans(spark):
    text = 'é api_key="short" API-KEY token = \'abc.def/ghi+jkl\' 0123456789abcdefAKIA' + "Z" * 15 + " AKIAshort"
    patterns = {r.name: (re.compile(r.pattern), r.group, r.least) for r in secrets.RULES}
    want = {n: [(m.start(), m.end()) for m in p.finditer(text) if len(m.group(g)) >= k] for n, (p, g, k) in patterns.items()}
    ledger = secrets.SecretLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    row = ledger.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {n: [(s["start"], s["end"]) for s in row[n]] for n in patterns} == want and sum(map(len, want.values())) == 3


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 300, 129 * 128, 40_000])
def test_texts_with_very_many_secrets(spark, n):
    text = "\n".join(f"{k:x}".rjust(16 + k % 3, "a") + (" short abc" if k % 5 == 0 else "") for k in range(n))
    found = spark.createDataFrame([(text,)], "text string").select(secrets.spans(F.col("text"), secrets.RULES[2]).alias("s")).first()["s"]
    assert [(x["start"], x["end"]) for x in found] == [m.span() for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]


def test_embeddings_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 24)) * 0.2, base[:30]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows, block=16).collect()}
    got, want = np.array([found[k] for k in range(len(x))]), near.sum(axis=1)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() and want.sum() > 100


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join(spark, seed):
    docs = documents(seed, 200)
    sets = {}
    for k, t in docs:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = [k for k, _ in docs]
    near = {(a, b) for a in ids for b in ids if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    component = {k: k for k in ids}
    for _ in ids:
        for a, b in near:
            component[a] = component[b] = min(component[a], component[b])
    want = {k: (sum(1 for a, _ in near if a == k), component[k]) for k in ids}
    found = ngram_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), block=8)
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == want


def brute_cosines(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("d, n", [(64, 1500), (48, 300)])
def test_embeddings_recall_at_the_threshold(spark, d, n):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(n, d))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = 0.9501
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * side])
    want = brute_cosines(x).sum(axis=1)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows).collect()}
    got = np.array([found[k] for k in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() >= 2 * n


def test_large_groups_of_close_vectors(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    close = one + rng.normal(size=(260, 16)) * 0.02
    apart = one + rng.normal(size=(60, 16)) * 0.25
    x = np.concatenate([close, apart, rng.normal(size=(40, 16))]).astype(np.float32)
    near = brute_cosines(x.astype(np.float64))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (32, 4096):
        found = embedding_dedup.near_duplicates(rows, block=block).collect()
        got = np.array([r["n_links"] for r in sorted(found, key=lambda r: r["vec_id"])])
        assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.99 * near.sum()
        assert len({r["component_id"] for r in found if r["vec_id"] < 260}) == 1


def brute_links(docs):
    """(n_links, component) of every document by comparing all pairs."""
    sets = {}
    for k, t in docs:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = [k for k, _ in docs]
    near = {(a, b) for a in ids for b in ids if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    n, component = dict.fromkeys(ids, 0), {k: k for k in ids}
    for a, _ in near:
        n[a] += 1
    while True:
        old = dict(component)
        for a, b in near:
            component[a] = component[b] = min(component[a], component[b])
        if component == old:
            return {k: (n[k], component[k]) for k in ids}


def close_copies(n, others, seed=1):
    """n texts that differ from one text in its last words, some in more; and ``others`` that differ in half of it."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(300)]
    out = []
    for k in range(n + others):
        w = list(base)
        for at in rng.sample(range(300), rng.choice([1, 2, 3]) if k < n else rng.choice([8, 12, 60])):
            w[at] = f"x{rng.randint(0, 10**6)}"
        out.append((k, " ".join(w)))
    return out


def test_large_groups_of_close_copies(spark):
    docs = close_copies(220, 30) + [(1000 + k, t) for k, t in documents(7, 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_links(docs)
    for block in (64, 4096):  # with balls and many cells, and with one cell
        found = ngram_join.similar_documents(frame, block=block, judged=block)
        assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == want


@pytest.mark.parametrize("n", [1000, 8000])
def test_cells_of_members_that_are_alike_stay_few(spark, n):
    rows = spark.range(n + 100).select(F.lit(1).alias("k"), F.col("id").alias("node"), F.when(F.col("id") < n, "ball").alias("ball"))
    written = common.cells(rows, "k", "node", 128, alike="ball")
    assert written.count() <= n + 100 * (2 + n // 128)
    # Every two members that are not alike meet just once.
    small = common.cells(rows.where("node % 7 = 0"), "k", "node", 16, alike="ball").select("cell", "chunk", "node", "ball")
    pairs = small.alias("a").join(small.alias("b"), F.expr("a.cell = b.cell and a.node < b.node and (a.chunk <> b.chunk or a.cell.p = a.cell.q)"))
    met = pairs.where("a.ball is null or b.ball is null").groupBy("a.node", "b.node").count()
    total = len(range(0, n + 100, 7))
    alike = len(range(0, n, 7))
    assert met.count() == total * (total - 1) // 2 - alike * (alike - 1) // 2 and met.where("count > 1").count() == 0


def test_close_copies_are_one_ball(spark):
    docs = close_copies(400, 0)
    tok = {k: ngram_join.tokens(ngram_join.shingles(t.encode())).tolist() for k, t in docs}
    sets = spark.createDataFrame([(k, k, 1, tok[k]) for k, _ in docs], "node long, id long, copies long, tok array<int>")
    found_in = sets.select(F.lit(1).cast("long").alias("k"), "node", F.lit(len(docs)).cast("long").alias("m"))
    rows = spark.createDataFrame([(k, bytearray(ngram_join.shingles(t.encode()).tobytes())) for k, t in docs], "node long, s binary")
    found = ngram_join.balls(found_in, sets, lambda nodes: rows.join(nodes, "node"), 0.8, 100)
    assert found.select("ball").distinct().count() == 1 and found.count() == 400
    assert ngram_join.balls(found_in, sets, None, 0.8, 1000) is None


def test_rows_of_tight_copies_grow_with_the_group(spark, monkeypatch):
    rows, cell_sizes, plain = [], [], ngram_join.by_cell

    def counted(df):
        df = common.cut(df)
        found = df.groupBy("cell").count().agg(F.sum("count"), F.max("count")).first()
        rows.append(found[0] or 0)
        cell_sizes.append(found[1] or 0)
        return plain(df)

    monkeypatch.setattr(ngram_join, "by_cell", counted)
    seen = {}
    for n in (1000, 2000):
        rows.clear()
        rng = random.Random(3)
        docs = []
        for k in range(n):
            w = [f"b{i}" for i in range(200)]
            for place in rng.sample(range(200), rng.choice([1, 2])):
                w[place] = f"x{rng.randint(0, 10**9)}"
            docs.append((k, " ".join(w)))
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        found = ngram_join.similar_documents(frame, block=128, judged=128).agg(F.sum("n_links"), F.countDistinct("component_id")).first()
        assert n * (n - 1) * 0.9999 <= found[0] <= n * (n - 1) and found[1] == 1
        seen[n] = sum(rows)
    # Rows that carry tokens or sets to a cell: a few for each copy, however many; no cell holds the group.
    assert seen[2000] <= 40 * 2000 and max(cell_sizes) <= 2 * 128 + 64


def test_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(6)
    text = " ".join("w" * rng.randint(1, 30) + str(rng.randint(0, 99)) for _ in range(500)).encode()
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(ngram_join, "PART", 37)
    assert np.array_equal(ngram_join.shingles(text), whole)


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["a" * 10, None, "", "b" * 100, "c", "d" * 30, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["k", "t"])
    found = [x.column(1).to_pylist() for x in common.portions(batch, 1, rows=3, size=32)]
    assert [t for part in found for t in part] == texts
    assert all(len(part) <= 3 and (len(part) == 1 or sum(len(t or "") for t in part) <= 32) for part in found)
    assert not list(common.portions(batch.slice(0, 0), 1))


def test_cells_come_whole():
    rng = random.Random(3)
    keys = sorted(rng.choices(range(30), k=400))
    table = pa.table({"k": pa.array(keys, pa.int64()), "q": pa.array([0] * 400, pa.int32())})
    seen = []
    for t, edges in common.whole_cells(iter(table.to_batches(max_chunksize=7)), ["k", "q"], rows=50):
        ks = t["k"].to_pylist()
        assert edges[0] == 0 and edges[-1] == len(ks)
        runs = [ks[a:b] for a, b in zip(edges, edges[1:])]
        assert all(len(set(r)) == 1 for r in runs)
        seen += [(r[0], len(r)) for r in runs]
        a, b = common.pairs_within(edges)
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(len(ks)) for j in range(i + 1, len(ks)) if ks[i] == ks[j]]
    assert seen == [(k, keys.count(k)) for k in sorted(set(keys))]


def test_first_shared_numbers():
    rng = random.Random(4)
    lists = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in range(60)]
    column = pa.array(lists, pa.list_(pa.int64()))
    a, b = np.array(range(60)), np.array([rng.randrange(60) for _ in range(60)])
    found = common.first_shared(common.padded(column, -1)[a], common.padded(column, -2)[b])
    assert found.tolist() == [min(set(lists[i]) & set(lists[j]), default=np.iinfo(np.int64).max) for i, j in zip(a, b)]


def test_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([rng.integers(0, 50, 30), rng.integers(0, 5000, 40)]).astype(np.uint64)) for _ in range(90)]
    found = ngram_join._overlap(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(90) for j in range(i))


def test_texts_that_share_an_id(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = [(1, "quite another text with words of its own"), (1, base), (2, base + " more"), (2, "a third text that nothing else is like at all")]
    found = ngram_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in found.collect()) == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (2, 1, 1)]


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randint(0, 9), j, i) for i in range(rng.randint(0, 6))) for j in range(k)]
        assert list(warc.loser_tree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_archives_refuse_broken_records():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(a, b) for a, _, b in warc.records(good * 2)] == [(0, b"ab"), (len(good), b"ab")]
    for bad in (good.replace(b"2", b"1"), good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARD/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(bad))
    # In parts of any size.
    for size in (1, 3, 7):
        found = warc.Records()
        assert [x for a in range(0, 2 * len(good), size) for x in found.add((good * 2)[a : a + size])] == list(warc.records(good * 2))


def test_archives_of_odd_payloads(spark):
    rng = random.Random(9)
    odd = ["".join(rng.choices(["\r", "\n", "\r\n", "\r\n\r\n", "a", "é", "WARC/1.1"], k=rng.randint(0, 12))) for _ in range(300)] + ["x" * 3_000_000, "\r\n\r\n" * 4]
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example/{k % 11}", t) for k, t in enumerate(odd)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = warc.archive_pages(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["url_key"], r["captured_at"], r["page_id"]) for r in found] == sorted((r["url_key"], r["captured_at"], r["page_id"]) for r in found)
    first = {}
    for k, t in enumerate(odd):
        first.setdefault(t, k)
    got = {r["page_id"]: (r["payload_digest"], r["payload_bytes"], r["refers_to"], r["captured_at"]) for r in found}
    day = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert got == {
        k: (
            base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), len(t.encode()), None if first[t] == k else first[t],
            (day + timedelta(seconds=k)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        )
        for k, t in enumerate(odd)
    }


def test_runs_have_to_be_sorted():
    with pytest.raises(ValueError):
        list(warc.loser_tree([[1, 3, 2], [1]], lambda r: (r,)))


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right >= 0.98 * n
    nothing = language_id.train(docs.withColumn("text", F.lit("x")).where("false"))
    assert language_id.predict_languages(docs.withColumn("text", F.lit("x")).limit(2), nothing).where("lang_pred = 'und'").count() == 2


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    clean, flagged, toxic, caught = rows.agg(
        *[F.count_if(F.expr(x)) for x in ("toxic = 0", "toxic = 0 and predicted = 1", "toxic = 1", "toxic = 1 and predicted = 1")]
    ).first()
    assert flagged <= 0.05 * clean and caught >= 0.65 * toxic


def plain_grams(text, least, most, inside, digits):
    """The n-grams of a text, one by one."""
    letter = str.isalnum if digits else str.isalpha
    c = [" ", *text.lower(), " "]
    w = [letter(x) for x in c]
    flat = [x if ok else " " for x, ok in zip(c, w)]
    out = []
    for n in range(least, most + 1):
        for a in range(len(c) - n + 1):
            if inside and not all(w[a + 1 : a + n - 1]):
                continue
            if not inside and not (w[a] or n > 1 and w[a + 1]):
                continue
            out.append("".join(flat[a : a + n]))
    return out


def bucket(gram, bits):
    """The bucket of an n-gram in plain arithmetic."""
    h = 0
    for x in gram:
        h = (h * 0x01000193 + ord(x)) % 2**32
    h = ((h ^ h >> 15) * 0x9E3779B1 + len(gram)) % 2**32
    return (h ^ h >> 16) * 0x85EBCA6B % 2**32 >> 32 - bits


@pytest.mark.parametrize("module, inside, digits", [(toxicity, True, True), (language_id, False, False)])
def test_ngrams_by_brute_force(module, inside, digits, monkeypatch):
    from deckloom.llm import ngrams

    for size in (ngrams.SLICE, 7):
        monkeypatch.setattr(ngrams, "SLICE", size)
        for text in ("", "a", "Ab c3 -- Déjà vu\n", "x" * 40, "one two  three, four!"):
            want = np.zeros(1 << module.BITS, dtype=int)
            for gram in plain_grams(text, module.LEAST, module.MOST, inside, digits):
                want[bucket(gram, module.BITS)] += 1
            assert np.array_equal(ngrams.counts(text, module.LEAST, module.MOST, module.BITS, inside=inside, digits=digits), want)


def test_toxicity_scores_by_brute_force():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.25)
    for text in ("such a text", "", "!!", "Zwölf Boxkämpfer jagen 3 mal"):
        grams = plain_grams(text, toxicity.LEAST, toxicity.MOST, True, True)
        mean = sum(float(model.weight[bucket(g, toxicity.BITS)]) for g in grams) / len(grams) if grams else 0.0
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(0.25 - mean)), abs=1e-9)


def test_toxicity_learning_by_brute_force(monkeypatch):
    """The same steps one document and one n-gram at a time."""
    monkeypatch.setattr(toxicity, "BITS", 6)
    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 64, 9)) for _ in range(40)]
    shares = [np.full(len(b), 1 / len(b), dtype=np.float32) for b in bags]
    y = np.array([int(b[0] < 6) for b in bags])
    found = toxicity.fit(bags, shares, y, seed=5)

    draw = np.random.default_rng(5)
    e = draw.uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (64, toxicity.DIM))
    w = draw.uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (2, toxicity.DIM))
    b, e_sum, w_sum, b_sum = np.zeros(2), np.full(64, 1e-10), np.full((2, toxicity.DIM), 1e-8), np.full(2, 1e-8)
    for epoch in range(toxicity.EPOCHS):
        rate, order = toxicity.RATE * (1 - epoch / toxicity.EPOCHS), draw.permutation(np.arange(40))
        for at in range(0, 40, toxicity.BATCH):
            rows = order[at : at + toxicity.BATCH]
            d_e, d_w, d_b = {}, np.zeros_like(w), np.zeros(2)
            for r in rows:
                h = sum(s * e[g] for g, s in zip(bags[r], shares[r]))
                p = np.exp(w @ h + b) / np.exp(w @ h + b).sum()
                error = (p - np.eye(2)[y[r]]) / len(rows)
                d_w += np.outer(error, h)
                d_b += error
                for g, s in zip(bags[r], shares[r]):
                    d_e[g] = d_e.get(g, 0) + s * (error @ w)
            for g, d in d_e.items():
                e_sum[g] += (d * d).sum()
                e[g] -= rate * d / np.sqrt(e_sum[g])
            w_sum += d_w * d_w
            w -= rate * d_w / np.sqrt(w_sum)
            b_sum += d_b * d_b
            b -= rate * 0.2 * d_b / np.sqrt(b_sum)
    assert np.allclose(found.weight, e @ (w[1] - w[0]), rtol=2e-3, atol=2e-3) and found.bias == pytest.approx(b[1] - b[0], abs=2e-3)


def test_votes_by_brute_force():
    rng = np.random.default_rng(6)
    classes = list("abcde")
    vote = language_id.Vote(classes, rng.normal(size=(10, 12)).astype(np.float32), rng.normal(size=10).astype(np.float32))
    x = rng.normal(size=(50, 12)).astype(np.float32)
    best, score = vote.winners(x)
    for row in range(50):
        wins, chance = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
        k = 0
        for i in range(5):
            for j in range(i + 1, 5):
                margin = min(5.0, max(-5.0, float(x[row] @ vote.weight[k] + vote.bias[k])))
                wins[classes[i] if margin >= 0 else classes[j]] += 1
                chance[classes[i]] += 1 / (1 + np.exp(-4 * margin))
                chance[classes[j]] += 1 / (1 + np.exp(4 * margin))
                k += 1
        first = max(classes, key=lambda c: (wins[c], chance[c]))
        assert classes[best[row]] == first and score[row] == pytest.approx(chance[first] / 4, abs=1e-5)


def test_machines_are_at_the_least_loss():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=120) > 0.4, 1.0, -1.0).astype(np.float32)
    w, b = language_id.machine(x, y)

    def loss(w, b):
        slack = np.maximum(0, 1 - y * (x @ w + b)) ** 2
        return slack[y > 0].mean() / 2 + slack[y < 0].mean() / 2 + language_id.PENALTY / 2 * (w @ w)

    least = loss(w, b)
    for _ in range(300):
        step = rng.normal(size=7) * 10 ** rng.uniform(-3, 0)
        assert loss(w + step[:6], b + step[6]) >= least - 1e-5


def test_unseen_spellings_share_ngrams():
    bags, y = [], []
    rng = np.random.default_rng(0)
    from deckloom.llm import ngrams

    plain = ["garden", "river", "window", "table", "paper", "yellow", "summer", "market"]
    for k in range(160):
        text = " ".join(rng.choice(plain, 6)) + (" horrible" if k % 2 else "")
        c = ngrams.counts(text, toxicity.LEAST, toxicity.MOST, toxicity.BITS, inside=True, digits=True)
        at = np.flatnonzero(c)
        bags.append((at.astype(np.int32), (c[at] / c.sum()).astype(np.float32)))
        y.append(k % 2)
    model = toxicity.fit([b[0] for b in bags], [b[1] for b in bags], np.array(y))
    base, odd = model.score("garden river window table"), model.score("garden river window table horrrible")
    assert odd > 0.5 > base


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert set(docs.columns) < set(rows.columns) and 0 < rows.count() < docs.count()
    assert rows.where("not round_trip").count() == 0
    texts = [r["text"] for r in rows.select("text").collect()]
    assert len(texts) == len(set(texts))
    again = stages.without_benchmark(spark, rows.select(*docs.columns), "/root/testdata/sf0.001")
    assert again.count() == rows.count()
