"""Operator 10: languages by a hierarchy of linear support vector machines.

A text is the square roots of the counts of its hashed character 1- to 3-grams,
scaled to length one. Machines for each two language families vote for the
family; machines for each two of its languages then vote for the language. More
than FAN families, or languages of one, are voted for in groups first. Each vote is
learned in a task (numpy, squared hinge loss) from a bounded sample of each language.
Predicting is one pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import aside, back, portions, table, with_text

LEAST, MOST, BITS = 1, 3, 12
#: Labelled rows of a language that are learned from at most; classes of a vote at most, and its rows, about.
PER_LANGUAGE, FAN, VOTE_ROWS = 1000, 16, 16_000
PENALTY, STEPS = 1e-4, 300
#: A text whose score is below this is in none of the learned languages clearly.
CLEAR = 0.3

#: Families of ISO 639-1 codes. A language of none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "ms"),
}


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.partition("-")[0].lower() in members), f"only {lang}")


def features(text: str | None) -> np.ndarray:
    x = np.sqrt(ngrams.counts(text, LEAST, MOST, BITS, inside=False, digits=False)).astype(np.float32)
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Vote:
    """Machines for each two of some classes."""

    classes: list[str]
    weight: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list[str]) -> Vote:
        w, b = [], []
        for one, other in combinations(classes, 2):
            rows = (y == one) | (y == other)
            found = machine(x[rows].astype(np.float32), np.where(y[rows] == one, 1.0, -1.0).astype(np.float32))
            w.append(found[0])
            b.append(found[1])
        return cls(classes, np.array(w, dtype=np.float32).reshape(len(w), x.shape[1]), np.array(b, dtype=np.float32))

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number with the most votes (of equals that with the largest margins), and the mean of its probabilities."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        p = 1.0 / (1.0 + np.exp(-4.0 * np.clip(x @ self.weight.T + self.bias, -5, 5)))
        votes, total = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            votes[:, i] += p[:, k] >= 0.5
            votes[:, j] += p[:, k] < 0.5
            total[:, i] += p[:, k]
            total[:, j] += 1 - p[:, k]
        best = np.argmax(votes + total / (n + 1), axis=1)
        return best, total[np.arange(len(x)), best] / (n - 1)


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that separate y = 1 from y = -1; both sides weigh the same. Momentum descent on the squared hinge loss."""
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    step_w, step_b = np.zeros_like(w), 0.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        g = -2 * side * y * slack
        step_w = 0.9 * step_w - 0.2 * (x.T @ g + PENALTY * w)
        step_b = 0.9 * step_b - 0.2 * float(g.sum())
        w, b = w + step_w, b + step_b
    return w, b


def _deal(node: str, names: list[str], leaf: str, out: dict[str, list[tuple[str, str]]]) -> None:
    """Adds each name's way from the node: (node, child), the last child being ``leaf`` and the name."""
    if len(names) <= FAN:
        for v in names:
            out[v].append((node, leaf + v))
        return
    for k in range(FAN):
        part, child = names[k * len(names) // FAN : (k + 1) * len(names) // FAN], f"{node}/{k}"
        for v in part:
            out[v].append((node, child))
        _deal(child, part, leaf, out)


def routes(langs: list[str]) -> list[tuple[str, str, str, int]]:
    """(language, node, child, rows) of all votes on the way to each language; those of a node have FAN children at most."""
    members: dict[str, list[str]] = {}
    for lang in sorted(langs):
        members.setdefault(family(lang), []).append(lang)
    to_family: dict[str, list] = {f: [] for f in members}
    to_lang: dict[str, list] = {v: [] for v in langs}
    _deal(ROOT, sorted(members), ROOT, to_family)
    for f, inside in members.items():
        _deal(ROOT + f, inside, "=", to_lang)
    steps = [(v, *step) for f, inside in members.items() for v in inside for step in (*to_family[f], *to_lang[v])]
    children: dict[str, dict[str, int]] = {}
    for _, node, child in steps:
        below = children.setdefault(node, {})
        below[child] = below.get(child, 0) + 1
    return [(v, n, c, min(PER_LANGUAGE, -(-VOTE_ROWS // (len(children[n]) * children[n][c])))) for v, n, c in steps]


#: The first vote. Names of nodes begin like it, those of languages with "=".
ROOT = ">"


@dataclass
class Model:
    votes: dict[str, Vote]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages (``und`` without a letter) and scores, the product of the probabilities of all votes."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.votes:
            return langs, scores
        rows = [k for k, t in enumerate(texts) if ngrams.has_letter(t)]
        for a in range(0, len(rows), 256):
            at = np.array(rows[a : a + 256])
            x = np.stack([features(texts[k]) for k in at])
            todo = [(ROOT, np.arange(len(at)), np.ones(len(at)))]
            while todo:
                node, inside, p = todo.pop()
                best, q = self.votes[node].winners(x[inside])
                for k in np.unique(best):
                    child, some = self.votes[node].classes[k], best == k
                    if child in self.votes:
                        todo.append((child, inside[some], p[some] * q[some]))
                        continue
                    scores[at[inside[some]]] = p[some] * q[some]
                    for row in at[inside[some]]:
                        langs[row] = child[1:]
        return langs, scores


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    """The machines of one node."""
    pdf = pdf.sort_values(["child", "y", "x"])  # one order, however the rows came
    x = np.frombuffer(b"".join(pdf["x"]), dtype=np.float16).reshape(len(pdf), -1)
    y = pdf["child"].to_numpy(dtype=object)
    vote = Vote.fit(x, y, sorted(set(y.tolist())))
    return pd.DataFrame({"node": [pdf["node"].iloc[0]], "classes": [vote.classes], "weight": [vote.weight.tobytes()], "bias": [vote.bias.tobytes()]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language, from a sample of its rows; rows without a letter are left out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("y"), F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)).alias("place"))
    total = rows.groupBy("y").count().collect()
    if not total:
        return Model({})
    spark = docs.sparkSession
    # Half as many again, of which the first are taken.
    least = spark.createDataFrame([(r[0], int(min(1.0, 1.5 * PER_LANGUAGE / r[1]) * (1 << 30))) for r in total], "y string, below long")
    chosen = rows.join(F.broadcast(least), "y").where("place < below")
    # Of rows that repeat an id one is learned from.
    chosen = chosen.groupBy("y", "place").agg(F.min("text").alias("text")).select("text", "y", "place")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in portions(whole, 0)):
            some = [k for k, t in enumerate(batch.column(0)) if ngrams.has_letter(t.as_py())]
            x = [features(batch.column(0)[k].as_py()).astype(np.float16).tobytes() for k in some]
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(x, pa.binary())], ["y", "place", "x"])

    place = W.partitionBy("y").orderBy("place", F.xxhash64("x"))
    found = chosen.mapInArrow(extract, "y string, place long, x binary").withColumn("r", F.row_number().over(place)).where(F.col("r") <= PER_LANGUAGE)
    steps = spark.createDataFrame(routes([r[0] for r in total]), "y string, node string, child string, rows int")
    dealt = found.join(F.broadcast(steps), "y").where("r <= rows").select("node", "child", "y", "x")
    learned = dealt.groupBy("node").applyInPandas(_learn, "node string, classes array<string>, weight binary, bias binary")
    votes = {}
    for r in learned.toLocalIterator():
        bias = np.frombuffer(bytes(r["bias"]), dtype=np.float32)
        votes[r["node"]] = Vote(list(r["classes"]), np.frombuffer(bytes(r["weight"]), dtype=np.float32).reshape(len(bias), 1 << BITS), bias)
    return Model(votes)


def predict_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    ``und`` with score 0 for a missing text and one without a letter, and for all
    texts if nothing was learned. Texts are read whole. Input columns named
    lang_pred or score are replaced; repeated rows stay.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows, own, at = with_text(docs, text_col, ["lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, at):
                langs, scores = known.value.predict(batch.column(at).to_pylist())
                cols = [*batch.columns[: len(own)], pa.array(langs, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(cols, [*own, "lang_pred", "score"])

    kept = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in own]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_languages(docs: DataFrame, clear: float = CLEAR) -> DataFrame:
    """The documents in one of the learned languages: with a letter, and a score that is clear. Columns stay as they are."""
    model = train(docs.where(~ngrams.held("doc_id", 5, 0)))
    if not model.votes:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    rows, meanwhile = aside(docs, ["lang_pred", "score"])
    marked = predict_languages(rows, model)
    return back(marked.where((F.col("lang_pred") != "und") & (F.col("score") >= clear)), docs, meanwhile)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~ngrams.held("doc_id", 5, 0)))
    return predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", ngrams.held("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


SQL: dict[str, str] = {}
