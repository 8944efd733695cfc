"""Operator 3: finds windows of benchmark items inside documents.

A prefix-filtered set join with containment as its predicate. All words of a
window have to occur, so a window's prefix is its one rarest word, rarity being
the number of documents that hold the word. Documents are probed with those
prefix words only; a probe fixes the window's place (positional bound), which has
to lie inside the document (length bound), and the words there are compared one
by one. Rarity is counted over all documents.

The windows are dealt into blocks of bounded size; each block is one pass over
the documents, so the benchmark may be of any size. Nothing is shuffled but word
counts. Hits and items of earlier blocks travel with the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, portions, table, with_text, words

#: Windows in one block, the most that a task holds at a time; items of a window that are listed together, more being listed as another one.
BLOCK_WINDOWS, LISTED = 50_000, 256
#: Passes that follow each other without a checkpoint; each has Python workers of its own.
CHAIN = 2


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window array<binary>, items array<string>): windows and the items that have them.

    A window that very many items have comes several times, with some of them each. One
    of items without an id has an empty list.
    """
    schema = "window array<binary>, item string"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    out.append(w[i : i + size])
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), pa.array(items, pa.string())], ["window", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    pairs = cut(items.mapInArrow(cut_up, schema).distinct())
    lists = cut(pairs.groupBy("window").agg(F.ceil(F.count("*") / LISTED).alias("lists")))
    dealt = pairs.join(lists, "window").withColumn("list", F.pmod(F.xxhash64("item"), F.col("lists")))
    return dealt.groupBy("window", "list").agg(F.collect_list("item").alias("items")).drop("list")


def _block_words(windows: list[list[bytes]]) -> set[bytes]:
    return {w for window in windows for w in window}


def _rarity(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = held.value, {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in vocab.intersection(words(text)):
                    total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r.w): r.n for r in counted.toLocalIterator()}


def _index(windows: list[tuple[list[bytes], list[str]]], seen: dict[bytes, int]) -> dict[bytes, list]:
    """Windows by their rarest word: (its place in the window, the window, items)."""
    found: dict[bytes, list] = {}
    for window, items in windows:
        rarest = min(window, key=lambda w: (seen.get(w, 0), w))
        if seen.get(rarest, 0):  # else no document has all words of the window
            found.setdefault(rarest, []).append((window.index(rarest), window, items))
    return found


def _probe(held, k_text: int, k_n: int, k_spans: int, k_items: int) -> object:
    """The pass over documents for one block: adds to spans, items and n_words. The columns are given by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        prefix = frozenset(index)
        for batch in (some for whole in batches for some in portions(whole, k_text)):
            n_words, all_spans, all_items = [], batch.column(k_spans).to_pylist(), batch.column(k_items).to_pylist()
            for row, text in enumerate(batch.column(k_text).cast(pa.binary()).to_pylist()):
                w = words(text)
                n_words.append(len(w))
                if prefix.isdisjoint(w):
                    continue
                spans, items = set(), set()
                for pos, word in enumerate(w):
                    if word not in prefix:
                        continue
                    for offset, window, ids in index[word]:
                        start = pos - offset
                        end = start + len(window)
                        if start >= 0 and end <= len(w) and w[start:end] == window:
                            spans.add((start, end))
                            items.update(ids)
                if spans:
                    all_spans[row] = _merged(all_spans[row] or [], spans)
                    all_items[row] = sorted({*(all_items[row] or []), *items})
            cols = list(batch.columns)
            cols[k_n] = pa.array(n_words, pa.int64())
            cols[k_spans] = pa.array(all_spans, batch.schema.field(k_spans).type)
            cols[k_items] = pa.array(all_items, batch.schema.field(k_items).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return run


def _merged(old: list[dict], new: set[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted({*new, *((s["start"], s["end"]) for s in old)}):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges of hits) and items (sorted ids as strings).

    A window is ``size`` consecutive words of an item, or all its words if it has
    fewer. Spans are disjoint, in order, with an exclusive end. A missing or
    empty text has no words, hence no hits; items without words have no windows,
    those without an id have spans but are not listed. With no item or no document
    nothing is hit. Repeated rows are each
    judged alike. Input columns named n_words, spans or items are replaced.
    """
    spark = docs.sparkSession
    rows, own, at = with_text(docs, text_col, ["n_words", "spans", "items"])
    names = {c: fresh(c, docs.columns) for c in ("n_words", "spans", "items")}
    kinds = {"n_words": "long", "spans": "array<struct<start:long,end:long>>", "items": "array<string>"}
    rows = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(name) for c, name in names.items()])
    windows = cut(item_windows(benchmark, item_col, item_text_col, size))
    blocks = max(1, -(-windows.count() // block_windows))
    # A frequent window has several lists of items, each of which may come into another block.
    dealt = windows.withColumn("b", F.pmod(F.xxhash64("window", "items"), F.lit(blocks)))
    for b in range(blocks):
        block = [([bytes(w) for w in r.window], list(r["items"])) for r in dealt.where(F.col("b") == b).toLocalIterator()]
        seen = _rarity(docs, text_col, _block_words([w for w, _ in block])) if block else {}
        held = spark.sparkContext.broadcast(_index(block, seen))
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        rows = rows.mapInArrow(_probe(held, at, *(rows.columns.index(c) for c in names.values())), schema)
        if b % CHAIN == CHAIN - 1 and b + 1 < blocks:
            rows = cut(rows)
    empty = {c: F.array().cast(kinds[c]) for c in ("spans", "items")}
    found = [F.coalesce(names[c], empty[c]).alias(c) if c in empty else F.col(names[c]).alias(c) for c in names]
    return rows.select(*own, *found)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = {
    "op3_decontamination": r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT item, len(ws[s:s + 9]) AS n, array_to_string(ws[s:s + 9], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS k
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT dw.r, dw.s, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
pos AS (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hits),
np AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(np.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(np.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN np USING (r) LEFT JOIN it USING (r)
"""
}
