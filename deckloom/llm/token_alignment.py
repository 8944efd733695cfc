"""Operator 11: which tokens of two tokenizers cover the same bytes, and how often their ids do so.

A byte-level BPE (A) and a SentencePiece model (B) cut one text differently. Two
tokens are linked if their byte ranges overlap. A union-find over this bipartite
graph gives its components, which are the smallest groups of tokens that cover the
same bytes on both sides; the members of a component, expanded in order of their
bytes, are its links. For each pair of ids the documents that hold it linked are
counted over the whole corpus, and each document's links are then judged by that.

A text is cut before a single space between two other characters; no token of
either side goes over such a place. The stretches in between are encoded and
aligned once and remembered, up to a bounded number, so a text costs little more
than looking its stretches up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, portions, roots, shared_dir, table, with_text

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches that a worker remembers, and the characters of those; stretches encoded in one string, and its characters.
MEMO, MEMO_CHARS, TOGETHER, TOGETHER_CHARS = 500_000, 16_000_000, 256, 8192
#: Ids are below 2^20, so that a pair of them is one number.
BITS = 20
#: Pairs of ids whose counts are sent to all tasks, at most; 17 bytes each.
SENT_PAIRS = 1 << 20
#: Before a space that stands alone.
CUT = re.compile(r"(?<=\S)(?= \S)")
ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible in Latin-1, else one from U+0100 on, in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)).difference(seen))
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Aligner:
    """Both tokenizers, and what is remembered of stretches. Memory is bounded by ``MEMO`` stretches or one portion of texts."""

    model_a: str
    model_b: str
    memo: dict[str, int] = field(default_factory=dict)
    groups: list[str] = field(default_factory=list)
    #: For each stretch: tokens of A, of B, groups, links, place of its first link; whether both sides give its bytes back.
    facts: np.ndarray = field(default_factory=lambda: np.zeros((0, 6), dtype=np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    chars: int = 0

    def __post_init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(self.model_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.model_b)
        if max(self.a.get_vocab_size(), self.b.get_piece_size()) > 1 << BITS:
            raise ValueError(f"vocabularies of up to {1 << BITS} ids are known here")
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.cuts = self._cuts(pieces)

    def _cuts(self, pieces: list[str]) -> bool:
        """Whether no token of either side goes over a single space between two other characters."""
        with open(self.model_a, encoding="utf-8") as f:
            given = json.load(f)
        before = given.get("pre_tokenizer") or {}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not given.get("normalizer")
        # Spaces stay as they are, one is put before, and none is inside a piece.
        kept = self.b.encode("a  b", out_type=str)
        return by_words and "".join(kept) == f"{MARK}a{MARK}{MARK}b" and all(MARK not in p.lstrip(MARK) for p in pieces)

    def look_up(self, parts: list[str]) -> np.ndarray:
        """The number of each stretch, all of which begin with a space. Numbers hold until the next call."""
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.memo, self.groups, self.chars = {}, [], 0
            self.facts, self.links = self.facts[:0], self.links[:0]
        new = [x for x in dict.fromkeys(parts) if x not in self.memo]
        if new:
            self._learn(new)
        return np.fromiter(map(self.memo.__getitem__, parts), dtype=np.int64, count=len(parts))

    def _learn(self, new: list[str]) -> None:
        ids_a, ids_b, sizes, good = self._encoded(new)
        self.chars += sum(map(len, new))
        n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((k for x in side for k in x), dtype=np.int64) for side in (ids_a, ids_b))
        # All stretches lie one behind the other; where one ends, tokens of both sides do.
        ends_a, ends_b, ends = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]), np.cumsum(sizes)
        reach = np.union1d(ends_a, ends_b)
        left, right = np.searchsorted(ends_a, reach), np.searchsorted(ends_b, reach)
        found = roots(len(flat_a) + len(flat_b), left, len(flat_a) + right)
        of_a, of_b = found[: len(flat_a)], found[len(flat_a) :]
        first = np.flatnonzero(np.diff(of_a, prepend=-1))  # of each component
        first_b = np.flatnonzero(np.diff(of_b, prepend=-1))
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        edges_a, edges_b = [*first.tolist(), len(flat_a)], [*first_b.tolist(), len(flat_b)]
        said = [
            f"{said_a[p]}|{said_b[r]}" if q - p == s - r == 1 else f"{','.join(said_a[p:q])}|{','.join(said_b[r:s])}"
            for p, q, r, s in zip(edges_a, edges_a[1:], edges_b, edges_b[1:])
        ]
        n_groups = np.diff(np.searchsorted(ends_a[np.append(first[1:], len(flat_a)) - 1] if len(flat_a) else ends_a, ends, side="right"), prepend=0)
        n_links = np.diff(np.searchsorted(reach, ends, side="right"), prepend=0)
        starts = len(self.links) + np.cumsum(n_links) - n_links
        self.links = np.concatenate([self.links, (flat_a[left] << BITS) | flat_b[right]])
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links, starts, good], axis=1)])
        at = 0
        for n in n_groups.tolist():
            self.groups.append(";".join(said[at : at + n]))
            at += n
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))

    def _encoded(self, new: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray, np.ndarray]:
        """Ids of both sides, bytes and goodness of each stretch. A stretch that does not come back has no ids."""
        raw = [x.encode() for x in new]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        out_a: list[list[int]] = [[] for _ in new]
        out_b: list[list[int]] = [[] for _ in new]
        good = np.zeros(len(new), dtype=np.int64)
        runs, alone, size = [[]], [], 0
        for k, x in enumerate(new):
            if not self.cuts or x[1:2].isspace() or x[-1].isspace() or len(x) > TOGETHER_CHARS:
                alone.append([k])
                continue
            if len(runs[-1]) >= TOGETHER or size > TOGETHER_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(k)
            size += len(x)
        todo = [r for r in runs if r] + alone
        while todo:
            again = []
            said = ["".join([new[k] for k in run]) for run in todo]
            found_a = [e.ids for e in self.a.encode_batch_fast(said, add_special_tokens=False)]
            found_b = self.b.encode([x[1:] for x in said], num_threads=1)
            for run, a, b in zip(todo, found_a, found_b):
                whole = b"".join([raw[k] for k in run])
                same = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
                if same:
                    ends = np.cumsum(sizes[run])
                    for ids, length, out in ((a, self.len_a, out_a), (b, self.len_b, out_b)):
                        at = np.searchsorted(np.cumsum(length[ids]), ends) + 1
                        for k, p, q in zip(run, [0, *at.tolist()], at.tolist()):
                            out[k] = ids[p:q]
                    good[run] = 1
                elif len(run) > 1:
                    again += [[k] for k in run]
                else:
                    sizes[run] = 0
            todo = again
        return out_a, out_b, sizes, good

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: (tokens of A, of B, groups, links), its groups as text; rows, pairs and times of all its linked ids."""
        parts: list[str] = []
        ends = []
        for text in texts:
            if text:
                parts += CUT.split(f" {text}") if self.cuts else [f" {text}"]
            ends.append(len(parts))
        at = self.look_up(parts)
        edges = np.array([0, *ends])
        of = np.repeat(np.arange(len(texts)), np.diff(edges))
        facts = self.facts[at]
        bad = np.zeros(len(texts), dtype=bool)
        bad[of[facts[:, 5] == 0]] = True
        facts[bad[of], :4] = 0
        sums = np.diff(np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(facts[:, :4], axis=0)])[edges], axis=0)
        said = ["" if bad[k] else ";".join(map(self.groups.__getitem__, at[p:q].tolist())) for k, (p, q) in enumerate(zip(edges.tolist(), ends))]
        n = facts[:, 3]
        place = np.arange(n.sum()) + np.repeat(facts[:, 4] - (np.cumsum(n) - n), n)
        keys, times = np.unique((np.repeat(of, n) << (2 * BITS)) | self.links[place], return_counts=True)
        return sums, said, keys >> (2 * BITS), keys & ((1 << 2 * BITS) - 1), times


def align_documents(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """``docs`` with what both tokenizers make of each text, one pass and no shuffle.

    n_a, n_b, n_groups, n_links (long): tokens, groups, and overlapping pairs of tokens.
    groups_sha256: SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``, which ``with_groups``
    adds as column groups. pairs (array<long>, a x 2^20 + b, in order) and times
    (array<int>): each linked pair of ids once, and how many links have it.

    A text that is missing or empty, or that one side does not give back byte by byte
    (after the space before it), has no tokens: zeros, an empty hash, empty arrays.
    Texts of any length are taken whole; a stretch without a single space between two
    other characters is encoded in one go, so memory follows the longest of those.
    Input columns named like a new one are replaced, all others pass; repeated rows
    stay, and an empty table is empty.
    """
    added = [*ADDED[:5], *(["groups"] if with_groups else []), *ADDED[5:]]
    rows, own, at = with_text(docs, text_col, added)
    kinds = {"groups_sha256": T.StringType(), "groups": T.StringType(), "pairs": T.ArrayType(T.LongType()), "times": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.select(*own).schema), *(T.StructField(c, kinds.get(c, T.LongType())) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(model_a, model_b)
        for whole in batches:
            for batch in portions(whole, at, size=4 << 20):
                sums, said, of, pairs, times = aligner.align(batch.column(at).to_pylist())
                offsets = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
                new = {name: pa.array(sums[:, k]) for k, name in enumerate(added[:4])}
                new["groups_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said], pa.string())
                new["groups"] = pa.array(said, pa.string()) if with_groups else None
                new["pairs"] = pa.ListArray.from_arrays(offsets, pa.array(pairs))
                new["times"] = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *(new[c] for c in added)], [*own, *added])

    return rows.mapInArrow(run, schema)


#: Aligners of a worker, which its later tasks find again.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(model_a: str, model_b: str) -> Aligner:
    key = (model_a, model_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): in how many rows two ids are linked, and whether no other id of B is linked with this one of A in more."""
    per = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", BITS)))
    most = per.groupBy("a").agg(F.max("n").alias("_most"))
    b = F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1))
    return per.join(most, "a").select("pair", "a", b.alias("b"), "n", (F.col("n") == F.col("_most")).alias("best"))


def _often(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are counted as often as that. The driver sees one row for each power."""
    sizes = counts.groupBy((F.length(F.bin("n")) - 1).alias("p")).count().collect()
    p, held = 64, 0
    for r in sorted(sizes, key=lambda r: -r["p"]):
        if held + r["count"] > most:
            break
        p, held = r["p"], held + r["count"]
    return 1 << p if p < 63 else (1 << 63) - 1


def judge_links(aligned: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` with n_best, the links whose pair is a best one of its A id, and count_sum, the counts of all links added up.

    The most frequent pairs, up to ``sent_pairs`` of them, are sent to all tasks; each
    of those is in very many rows. The links of rarer ones are joined with their
    counts by a shuffle, where no pair can be frequent. ``aligned`` has to come from a table,
    as it is read twice. Its arrays pairs and times go.
    """
    spark = aligned.sparkSession
    counts = cut(counts)
    least = _often(counts, sent_pairs)
    often = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()
    order = np.argsort(often["pair"].to_numpy())
    held = spark.sparkContext.broadcast(tuple(often[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    own = [c for c in aligned.columns if c not in ("pairs", "times")]
    left = fresh("rare", own)
    added = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField(left, T.ArrayType(T.StructType.fromDDL("pair long, times int")))])
    kept = aligned.select(*[c for c in own if c not in ("n_best", "count_sum")], "pairs", "times")
    names = kept.columns[:-2]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kept.schema.fields[:-2]), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lists = batch.column(len(names))
                asked, times = lists.flatten().to_numpy(), batch.column(len(names) + 1).flatten().to_numpy()
                of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                at = np.searchsorted(pairs, asked)
                known = at < len(pairs)
                known[known] = pairs[at[known]] == asked[known]
                hit, weight = at[known], times[known].astype(np.int64)
                total, chosen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(total, of[known], n[hit] * weight)
                np.add.at(chosen, of[known], best[hit] * weight)
                offsets = pa.array(np.searchsorted(of[~known], np.arange(batch.num_rows + 1)).astype(np.int32))
                rest = pa.StructArray.from_arrays([pa.array(asked[~known]), pa.array(times[~known])], ["pair", "times"])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(chosen), pa.array(total), pa.ListArray.from_arrays(offsets, rest)], [*names, "n_best", "count_sum", left])

    judged = kept.mapInArrow(run, schema)
    rare = counts.where(F.col("n") < least)
    if rare.isEmpty():
        return judged.drop(left)
    row = fresh("row", [*names, left])
    rows = cut(judged.withColumn(row, F.monotonically_increasing_id()))
    links = rows.select(row, F.explode(left).alias("_l")).select(row, "_l.pair", "_l.times")
    more = links.join(rare.select("pair", "n", "best"), "pair").groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")
    )
    return rows.join(more, row, "left").select(
        *names, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )


def align_corpus(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``docs`` without their texts, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum.

    Texts are encoded once: their linked ids are written to the shared folder, counted
    from there and judged from there.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    # Sorted numbers in a column are kept as differences.
    aligned = align_documents(docs, model_a, model_b, text_col).drop(text_col)
    aligned.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    return judge_links(aligned, count_pairs(aligned), sent_pairs)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align_corpus(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SQL: dict[str, str] = {}
