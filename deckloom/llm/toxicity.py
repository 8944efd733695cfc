"""Operator 7: toxicity by averaged subword embeddings under a linear softmax.

A text is the bag of the character 3- to 5-grams of its words, with the blanks
beside a word as marks of its ends. Every n-gram, hashed into 2^BITS buckets, has a
vector; their average goes through a linear softmax of two classes. Vectors and
softmax are learned together in numpy, with AdaGrad over small batches, from a
bounded sample of labelled rows. A word not seen before is scored through the
n-grams that it shares with others.

Both parts are linear, so for scoring each bucket is one number and a text's logit
the mean of its n-grams' numbers: one pass over the texts, no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import cut, portions, table, with_text

LEAST, MOST, BITS, DIM = 3, 5, 16, 8
#: Labelled documents of each class that are learned from, about; entries of their bags in all, about, of four bytes each on the driver.
SAMPLE, ENTRIES = {1: 1500, 0: 6000}, 24_000_000
EPOCHS, BATCH, RATE = 6, 32, 0.5
THRESHOLD = 0.3
#: Shares travel to the driver as halves; small ones would lose digits unscaled.
SCALE = 256.0


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        if text:
            for c, w, starts in ngrams.slices(text, True, MOST):
                for ids in ngrams.hashed(c, w, starts, LEAST, MOST, BITS, inside=True):
                    total += float(self.weight[ids].sum(dtype=np.float64))
                    n += len(ids)
        logit = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (some for whole in batches for some in portions(whole, 0)):
        ids, shares = [], []
        for text in batch.column(0):
            c = ngrams.counts(text.as_py(), LEAST, MOST, BITS, inside=True, digits=True)
            at = np.flatnonzero(c)
            ids.append(at.astype(np.uint16).tobytes())
            shares.append((c[at] / max(1, c.sum()) * SCALE).astype(np.float16).tobytes())
        place = [zlib.crc32(str(k).encode()) >> 2 for k in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(ids, pa.binary()), pa.array(shares, pa.binary()), pa.array(place, pa.int64())], ["label", "ids", "shares", "place"]
        )


def fit(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, seed: int = 1, scale: float = 1.0) -> Model:
    """Learns n-gram vectors and softmax from bags (buckets and their shares of the text, times ``scale``)."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w = rng.uniform(-1 / DIM, 1 / DIM, (2, DIM)).astype(np.float32)
    b = np.zeros(2, dtype=np.float32)
    e_sum, w_sum, b_sum = np.full(1 << BITS, 1e-10, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    known = np.flatnonzero([len(i) > 0 for i in ids])
    for epoch in range(EPOCHS if len(known) else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(known)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            flat = np.concatenate([ids[r] for r in rows]).astype(np.int64)
            share = np.concatenate([shares[r] for r in rows]).astype(np.float32) / np.float32(scale)
            starts = np.cumsum([0, *(len(ids[r]) for r in rows[:-1])])
            row_of = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
            h = np.add.reduceat(e[flat] * share[:, None], starts, axis=0)
            z = h @ w.T + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            grad_w, grad_b, grad_h = error.T @ h, error.sum(axis=0), error @ w
            seen, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, share * grad_h[row_of, d], len(seen)) for d in range(DIM)], axis=1).astype(np.float32)
            e_sum[seen] += (grad * grad).sum(axis=1)
            e[seen] -= rate * grad / np.sqrt(e_sum[seen])[:, None]
            w_sum += grad_w * grad_w
            w -= rate * grad_w / np.sqrt(w_sum)
            b_sum += grad_b * grad_b
            b -= rate * 0.2 * grad_b / np.sqrt(b_sum)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: dict[int, int]) -> Model:
    """A model from about ``sample[label]`` labelled documents of each label.

    Labels other than 0 and 1 are left out; so are documents labelled both ways. Of
    rows that repeat an id one is learned from. If the bags have more than ``ENTRIES``
    entries, as with very long texts, a share of the documents is taken that has about as many.
    Without a row of either label every score is that of the one there is, and
    0.5 without any.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    marked = marked.where("_y = _z").select(F.col(id_col).alias("_id"), F.col("_y").cast("int").alias("_y"))
    chosen = ngrams.bounded_sample(marked, "_id", "_y", sample)  # at most 2 x sample + 1000 rows: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    one = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select(F.col("x.text").alias("text"), "_y", "_id")
    made = cut(one.mapInArrow(_features, "label int, ids binary, shares binary, place long"))
    entries = made.agg(F.sum(F.octet_length("ids")) / 2).first()[0] or 0
    if entries > ENTRIES:
        made = made.where(F.col("place") < int(ENTRIES / entries * (1 << 30)))
    found = sorted((r["label"], bytes(r["ids"]), bytes(r["shares"])) for r in made.toLocalIterator())  # one order, however the rows came
    ids = [np.frombuffer(x, dtype=np.uint16) for _, x, _ in found]
    shares = [np.frombuffer(x, dtype=np.float16) for _, _, x in found]
    return fit(ids, shares, np.array([y for y, _, _ in found], dtype=np.int64), scale=SCALE)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (0 or 1).

    A missing text, an empty one and one without letters or digits get the score of the
    bias alone. Texts are scored whole. Input columns named score or predicted are
    replaced; repeated rows stay.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows, own, at = with_text(docs, text_col, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            scores = np.array([m.score(t.as_py()) for t in batch.column(at)], dtype=np.float64)
            cols = [*batch.columns[: len(own)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*own, "score", "predicted"])

    kept = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in own]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~ngrams.held("doc_id", 4, 2))
    model = train(docs, labels, "doc_id", "text", "toxic", SAMPLE)
    return score_documents(docs, model).select("doc_id", ngrams.held("doc_id", 4, 2).alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}
