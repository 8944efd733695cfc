"""Token alignment against a plain reading of its definition."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deckloom.llm import token_alignment as alignment
from deckloom.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  spaces ", "tab\tand\nlines \n\n x", "a▁b", "▁", "naïve façade, 漢字 かな 🙂🙂", "<|endoftext|> it's <s> we'll", "x" * 300,
    " no break space", "a  b c   d", "é combining", "\x00 zero", "word " * 50, " lead", "trail ", "deadbeef" * 40, "1234567 89 0",
]
LETTERS = alignment.byte_alphabet()


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(alignment.MODEL_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)


def plain(sides, text):
    """(ids of A, of B, groups as text, links) by whole texts, byte by byte."""
    nothing = [], [], "", []
    if not text:
        return nothing
    a, b = sides
    want = f" {text}".encode()
    ids_a = a.encode(f" {text}", add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return nothing
    of_a = [i for i, x in enumerate(bytes_a) for _ in x]
    of_b = [i for i, x in enumerate(bytes_b) for _ in x]
    links = sorted(set(zip(of_a, of_b)))
    groups, ga, gb = [], [], []
    for k in range(len(want)):
        last = k + 1 == len(want)
        if last or of_a[k] != of_a[k + 1]:
            ga.append(str(ids_a[of_a[k]]))
        if last or of_b[k] != of_b[k + 1]:
            gb.append(str(ids_b[of_b[k]]))
        if last or (of_a[k] != of_a[k + 1] and of_b[k] != of_b[k + 1]):
            groups.append(f"{','.join(ga)}|{','.join(gb)}")
            ga, gb = [], []
    return ids_a, ids_b, ";".join(groups), [(ids_a[i], ids_b[j]) for i, j in links]


def expected(sides, rows):
    found = {k: plain(sides, text) for k, text in rows}
    counts = Counter(pair for *_, links in found.values() for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return {
        k: (
            len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for k, (a, b, groups, links) in found.items()
    }


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent_pairs", [1 << 20, 100, 0])
def test_odd_texts(spark, sides, sent_pairs):
    rows = list(enumerate(ODD * 2 + ["the same words in two texts"] * 3))
    found = alignment.align_corpus(spark.createDataFrame(rows, "doc_id long, text string"), sent_pairs=sent_pairs)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()} == expected(sides, rows)


def test_given_documents(spark, sides):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = alignment.op11_token_alignment(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found} == expected(sides, rows)
    assert sum(r["n_best"] for r in found) < sum(r["n_links"] for r in found)


def test_stretches_are_forgotten(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    texts = [r[0] for r in table(spark, SF, "documents").select("text").limit(60).collect()] + ODD
    aligner = alignment.Aligner(alignment.MODEL_A, alignment.MODEL_B)
    assert aligner.cuts
    for text in texts:
        sums, said, *_ = aligner.align([text])
        a, b, groups, links = plain(sides, text)
        assert said == [groups] and sums[0].tolist() == [len(a), len(b), groups.count(";") + 1 if groups else 0, len(links)]


def test_whole_texts_where_cutting_is_not_safe(sides):
    aligner = alignment.Aligner(alignment.MODEL_A, alignment.MODEL_B)
    aligner.cuts = False
    assert aligner.align(ODD)[1] == [plain(sides, text)[2] for text in ODD]


def test_rare_pairs_and_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "some text here", "x", 9), (1, "some text here", "x", 9), (None, None, None, None)], "doc_id long, text string, rare string, n_best int")
    found = alignment.align_corpus(docs, sent_pairs=0).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r["rare"] for r in found] == [None, "x", "x"] and [r["n_best"] for r in found] == [0, found[1]["n_links"], found[2]["n_links"]]
    assert alignment.align_corpus(docs.limit(0)).count() == 0


def test_groups_as_a_column(spark, sides):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k long, text string")
    found = {r["k"]: r["groups"] for r in alignment.align_documents(docs, with_groups=True).collect()}
    assert found == {k: plain(sides, t)[2] for k, t in enumerate(ODD)}
