"""Operator 4: SentencePiece ids by a streaming Viterbi search, and texts from ids.

The best path over a model's pieces is found from left to right. Only the last
``max_len`` boundaries are needed to go on; backpointers are kept until the paths
from all of those boundaries meet in one boundary, up to which the ids are then
final and leave the window. Two places where that always happens are known
beforehand: before a space mark that follows another character, as no piece has
one inside, and around a character of no piece. The short ones of the stretches
between such places are searched once and remembered, up to a bounded number, the
longest unused ones going first; those that are new are searched side by side,
boundary by boundary. A text is taken in portions, so memory does not follow its
length.

What makes a path best depends on the model's type. In a unigram model it is the
sum of the piece scores. In a BPE model a step from one piece to the next costs
nothing if merging their joined characters gives just these two pieces again, and
is barred otherwise; then one path alone reaches each boundary, and it is what
merging the whole text up to there gives. So the ids are those that merging the
whole text would give.

Spaces become the mark U+2581 and one is put before the text. Characters without
a piece are written as byte pieces. A U+2581 of the text itself is written as
bytes too, so that decoding gives every text back exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, portions, small_batches, table, with_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches that a worker remembers in each of two generations, and the longest that it does; places for pairs of pieces, as bits.
MEMO, MEMO_CHARS, PAIR_BITS = 60_000, 48, 20
#: Stretches that are searched side by side, those looked up at a time, and characters of a text that are cut up at a time.
ABREAST, LOOKED_UP, PORTION = 8192, 65_536, 1 << 20


class Lookup:
    """A table from numbers of 0 or more to small numbers, asked and filled by arrays. It is made for half as many as it has places."""

    def __init__(self, bits: int):
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.size = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each number, or the empty one where it would go; whether it is there."""
        at = ((asked.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        todo = np.flatnonzero((held != asked) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.last
            held[todo] = self.keys[at[todo]]
            todo = todo[(held[todo] != asked[todo]) & (held[todo] >= 0)]
        return at, held == asked

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Numbers that are not there yet, each once."""
        self.size += len(keys)
        while len(keys):
            at = self.find(keys)[0]
            self.keys[at] = keys  # of several for one place the last stays
            lost = self.keys[at] != keys
            self.values[at[~lost]] = values[~lost]
            keys, values = keys[lost], values[lost]


@dataclass
class Tree:
    """The beginnings of all pieces: edges (node x 2^21 + character) with the nodes that they lead to, and the piece that ends at a node (-1: none)."""

    edges: Lookup
    piece: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, score: dict[str, tuple[float, int]]) -> Tree:
        nodes, edges, piece, value = {"": 0}, {}, [-1], [0.0]
        for name, (points, k) in score.items():
            for size in range(1, len(name) + 1):
                if name[:size] not in nodes:
                    nodes[name[:size]] = len(piece)
                    edges[(nodes[name[: size - 1]] << 21) + ord(name[size - 1])] = len(piece)
                    piece.append(-1)
                    value.append(0.0)
            piece[nodes[name]], value[nodes[name]] = k, points
        found = Lookup(max(4, len(edges).bit_length() + 2))
        found.add(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        return cls(found, np.array(piece, dtype=np.int32), np.array(value))

    def down(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes; 0 where there is none."""
        at, known = self.edges.find((node << 21) + char)
        return np.where(known, self.edges.values[at], 0).astype(np.int64)


@dataclass
class Pieces:
    """The piece table of a model; its size is that of the vocabulary."""

    score: dict[str, tuple[float, int]]
    byte_ids: list[int]
    unknown: float
    text: list[bytes]
    name: list[str]
    max_len: int
    stretch: re.Pattern | None
    #: Whether pieces are merged pairs (BPE), whose steps are judged by ``follows``.
    merged: bool = False
    #: Ids of stretches, as the bytes of 32-bit integers; those of the generation before.
    memo: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    #: Whether steps from piece to piece, as before x 2^20 + next, are allowed, of those that were judged.
    steps: Lookup | None = None
    tree: Tree | None = None

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            return cls.of(sentencepiece_model_pb2.ModelProto.FromString(f.read()))

    @classmethod
    def of(cls, proto) -> Pieces:
        import sentencepiece

        kinds = {1: "unigram", 2: "bpe"}
        kind = kinds.get(proto.trainer_spec.model_type)
        if kind is None:
            raise ValueError("only unigram and BPE models are known here")
        model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        score, text = {}, [b""] * model.get_piece_size()
        byte_ids = [-1] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                byte_ids[int(piece[3:5], 16)] = k
                text[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                score[piece] = (model.get_score(k), k)
                text[k] = piece.replace(MARK, " ").encode()
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces, so texts could not be given back")
        apart = all(MARK not in p.lstrip(MARK) for p in score)
        own_line = not any("\n" in p for p in score)
        stretch = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if own_line else rf"{MARK}*[^{MARK}]+|{MARK}+") if apart else None
        lowest = min(s for s, _ in score.values())
        return cls(score, byte_ids, lowest - 10.0, text, [model.id_to_piece(k) for k in range(len(text))], max(map(len, score)), stretch, kind == "bpe", tree=Tree.of(score))

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """In a BPE model: whether merging the characters of both pieces leaves just these two. -1: no piece before."""
        asked = (before.astype(np.int64) + 1 << 20) + piece
        self.steps = self.steps or Lookup(PAIR_BITS)
        at, known = self.steps.find(asked)
        if not known.all():
            unseen = np.unique(asked[~known])
            if self.steps.size + len(unseen) > 1 << PAIR_BITS - 1:
                self.steps = Lookup(max(PAIR_BITS, len(asked).bit_length() + 1))
                unseen = np.unique(asked)
            self.steps.add(unseen, np.array([self._follows(int(x >> 20) - 1, int(x & 0xFFFFF)) for x in unseen], dtype=np.int32))
            at = self.steps.find(asked)[0]
        return self.steps.values[at] > 0

    def _follows(self, before: int, piece: int) -> bool:
        parts = [self.name[k] for k in (before, piece) if k >= 0]
        return self.merge("".join(parts)) == parts

    def merge(self, s: str) -> list[str]:
        """The pieces that are left when the best pair, of equals the first, is merged again and again. For short strings."""
        parts, get = list(s), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


@dataclass
class Window:
    """Backpointers of stretches side by side: best score (-inf: no path comes here), length and id of the last piece (-1: unknown character)."""

    best: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def start(cls, rows: int, width: int) -> Window:
        out = cls(np.full((rows, width), -np.inf), np.zeros((rows, width), np.int64), np.full((rows, width), -1, np.int64))
        out.best[:, 0] = 0.0
        return out

    def slide(self, by: int) -> Window:
        """The boundaries from ``by`` on, with room for as many new ones behind."""
        fresh = Window.start(len(self.best), self.best.shape[1])
        for mine, theirs in zip((self.best, self.size, self.ids), (fresh.best, fresh.size, fresh.ids)):
            theirs[:, : mine.shape[1] - by] = mine[:, by:]
        fresh.best -= self.best[:, by : by + 1]
        return fresh


def extend(pieces: Pieces, window: Window, i: int, chars: np.ndarray, left: np.ndarray) -> None:
    """Takes the paths at boundary i on by all pieces. chars: what follows (rows x max_len or fewer), left: how many characters do."""
    rows = np.flatnonzero((left > 0) & (window.best[:, i] > -np.inf))
    known = np.zeros(len(left), dtype=bool)
    at, node = rows, np.zeros(len(rows), dtype=np.int64)
    for size in range(1, chars.shape[1] + 1):
        node = pieces.tree.down(node, chars[at, size - 1])
        at, node = at[node > 0], node[node > 0]
        if not len(at):
            break
        ends = pieces.tree.piece[node] >= 0
        r, k, value = at[ends], pieces.tree.piece[node[ends]], pieces.tree.score[node[ends]]
        if size == 1:
            known[r] = True
        if pieces.merged:
            free = window.best[r, i + size] == -np.inf
            r, k = r[free], k[free]
            ok = pieces.follows(window.ids[r, i], k)
            r, k, value = r[ok], k[ok], np.zeros(ok.sum())
        else:
            value = window.best[r, i] + value
            ok = value > window.best[r, i + size]
            r, k, value = r[ok], k[ok], value[ok]
        window.best[r, i + size], window.size[r, i + size], window.ids[r, i + size] = value, size, k
        more = left[at] > size
        at, node = at[more], node[more]
    lost = rows[~known[rows]]
    value = window.best[lost, i] + pieces.unknown
    ok = np.isneginf(window.best[lost, i + 1]) if pieces.merged else value > window.best[lost, i + 1]
    window.best[lost[ok], i + 1], window.size[lost[ok], i + 1], window.ids[lost[ok], i + 1] = value[ok], 1, -1


#: A character after which a stretch ends.
WORD_END = re.compile(rf"[^{MARK}](?={MARK})")


def _chars(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def abreast(pieces: Pieces, stretches: list[str]) -> list[bytes]:
    """The ids of the best paths over short stretches."""
    m = max(map(len, stretches))
    chars = _chars("".join([s.ljust(m, "\0") for s in stretches])).reshape(len(stretches), m)
    n = np.array([len(s) for s in stretches])
    window = Window.start(len(stretches), m + 1)
    for i in range(m):
        extend(pieces, window, i, chars[:, i : min(m, i + pieces.max_len)], n - i)
    # The boundaries on the best paths, all stretches going back one piece at a time.
    on_path = np.zeros(window.ids.shape, dtype=bool)
    rows, at = np.arange(len(n)), n.copy()
    while len(rows):
        on_path[rows, at] = True
        at = at - window.size[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    ends = np.cumsum(on_path.sum(axis=1)) * 4
    flat = window.ids[on_path].astype(np.int32).tobytes()
    out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    for row in np.flatnonzero((on_path & (window.ids < 0)).any(axis=1)).tolist():
        out[row] = _path(pieces, stretches[row], window.size[row], window.ids[row], len(stretches[row])).tobytes()
    return out


def viterbi(pieces: Pieces, s: str) -> Iterator[int]:
    """The ids of the best path over s, each as soon as it is final. Of equal paths that with the longest last piece wins."""
    width, chars, base = pieces.max_len, _chars(s), 0
    window = Window.start(1, 6 * width)
    for i in range(len(s)):
        left = np.array([len(s) - i])
        extend(pieces, window, i - base, chars[None, i : i + width], left)
        if i - base + 1 + width >= window.best.shape[1] - width:
            meet = _meeting(window, i - base + 1, min(i - base + width, len(s) - base))
            if meet:
                yield from _path(pieces, s[base : base + meet], window.size[0], window.ids[0], meet)
                window, base = window.slide(meet), base + meet
            else:
                window = Window(*(np.pad(x, ((0, 0), (0, width)), constant_values=v) for x, v in ((window.best, -np.inf), (window.size, 0), (window.ids, -1))))
    yield from _path(pieces, s[base:], window.size[0], window.ids[0], len(s) - base)


def _meeting(window: Window, first: int, final: int) -> int:
    """The last boundary that the paths to all boundaries of a window share."""
    open_ends = {b for b in range(first, final + 1) if window.best[0, b] > -np.inf}
    while len(open_ends) > 1:
        b = max(open_ends)
        open_ends.discard(b)
        open_ends.add(b - int(window.size[0, b]))
    return open_ends.pop()


def _path(pieces: Pieces, s: str, size: np.ndarray, ids: np.ndarray, end: int) -> array:
    """The ids of the path to boundary ``end``."""
    out = []
    while end > 0:
        k, n = int(ids[end]), int(size[end])
        out += [k] if k >= 0 else [pieces.byte_ids[b] for b in reversed(s[end - n : end].encode())]
        end -= n
    out.reverse()
    return array("i", out)


def encode_texts(pieces: Pieces, texts: list[str | None]) -> list[bytes]:
    """Ids of texts, as the bytes of 32-bit integers; none for an empty or missing one."""
    out: list[list[bytes]] = [[] for _ in texts]
    parts: list[str] = []
    runs: list[tuple[int, int]] = []  # rows and how many stretches of theirs wait

    def look_up() -> None:
        ids, at = _ids(pieces, parts), 0
        for row, n in runs:
            out[row].append(b"".join(ids[at : at + n]))
            at += n
        parts.clear()
        runs.clear()

    for row, text in enumerate(texts):
        for some in _stretches(pieces, text) if text else ():
            parts += some
            runs.append((row, len(some)))
            if len(parts) >= LOOKED_UP:
                look_up()
    look_up()
    return [b"".join(x) for x in out]


def _ids(pieces: Pieces, parts: list[str]) -> list[bytes]:
    """The ids of each stretch; what is not remembered is searched."""
    if len(pieces.memo) > MEMO:
        pieces.older, pieces.memo = pieces.memo, {}
    memo, older = pieces.memo, pieces.older
    memo[""] = array("i", [pieces.byte_ids[b] for b in MARK.encode()]).tobytes()
    new = []
    for x in set(parts).difference(memo):
        if x in older:
            memo[x] = older[x]
        else:
            new.append(x)
    new.sort(key=len)
    long = [x for x in new if len(x) > MEMO_CHARS]
    short = new[: len(new) - len(long)]
    for a in range(0, len(short), ABREAST):
        memo.update(zip(short[a : a + ABREAST], abreast(pieces, short[a : a + ABREAST])))
    memo.update((x, array("i", viterbi(pieces, x)).tobytes()) for x in long)
    out = list(map(memo.__getitem__, parts))
    for x in long:
        del memo[x]
    return out


def _stretches(pieces: Pieces, text: str) -> Iterator[list[str]]:
    """The stretches of a text with its spaces as marks, a portion at a time; an empty one stands for a mark of the text itself."""
    for n, part in enumerate(text.split(MARK)):
        if n:
            yield [""]
        s = part.replace(" ", MARK) if n else MARK + part.replace(" ", MARK)
        if not pieces.stretch:
            yield [s] if s else []
            continue
        while len(s) > PORTION:
            found = WORD_END.search(s, PORTION)
            end = found.end() if found else len(s)
            yield pieces.stretch.findall(s[:end])
            s = s[end:]
        yield pieces.stretch.findall(s)


def decode(pieces: Pieces, ids: pa.Array) -> list[bytes | None]:
    """UTF-8 of the texts of id lists, None for a missing one. Ids without a text of their own (unknown, control) give nothing."""
    texts = pa.array(pieces.text, pa.large_binary()).take(ids.values)
    if not len(texts):
        return [b"" if x.is_valid else None for x in ids]
    # The texts of a row's ids lie next to each other, so joining them is a matter of offsets.
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[ids.offsets.to_numpy()]
    data = memoryview(texts.buffers()[2])
    return [
        None if missing else bytes(data[a + (data[a : a + 1] == b" ") : b]) if a < b else b""
        for missing, a, b in zip(ids.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist())
    ]


def _encode_with(docs: DataFrame, model: str, text_col: str, checked: bool) -> DataFrame:
    """One pass and no shuffle: ids and n_ids, and if ``checked`` also round_trip and decoded_crc32."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    added = ["ids", "n_ids", *(["round_trip", "decoded_crc32"] if checked else [])]
    rows, own, at = with_text(docs, text_col, added)
    types = [*(T.StructField(f.name, f.dataType, True) for f in docs.select(*own).schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType())]
    if checked:
        types += [T.StructField("round_trip", T.BooleanType()), T.StructField("decoded_crc32", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for whole in batches:
            for batch in portions(whole, at):
                texts = batch.column(at)
                found = encode_texts(pieces, texts.to_pylist())
                n = np.array([len(x) // 4 for x in found], dtype=np.int32)
                offsets = pa.array(np.cumsum([0, *n]).astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                cols = [*batch.columns[: len(own)], ids, pa.array(n)]
                if checked:
                    back = decode(pieces, ids)
                    same = [x == y for x, y in zip(back, texts.cast(pa.binary()).to_pylist())]
                    cols += [pa.array(same, pa.bool_()), pa.array([None if x is None else zlib.crc32(x) for x in back], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*own, *added])

    return rows.mapInArrow(run, T.StructType(types))


def encode_documents(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>) and n_ids, one pass and no shuffle.

    A missing text has missing ids and n_ids 0; an empty one has no ids. Texts
    of any length are encoded whole. A stretch without a place where all paths meet
    keeps its whole window until its end; such are those of more characters than
    ``MEMO_CHARS`` without a space. Input columns named ids or n_ids are
    replaced, all others pass, so repeated rows stay and an empty table is empty.
    """
    return _encode_with(docs, model, text_col, False)


def round_trip_documents(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``encode_documents`` with round_trip, whether the ids decode to the text, and decoded_crc32 of what they decode to.

    Both in one pass. A missing text gives missing ids, round_trip true and a missing
    checksum. Input columns of these four names are replaced.
    """
    return _encode_with(docs, model, text_col, True)


def decode_documents(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; missing ids give a missing text, none an empty one.

    Bytes that are no UTF-8 become U+FFFD. A column named like the new one is replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))
    own = [c for c in rows.columns if c != out_col]
    small_batches(rows.sparkSession)
    made = fresh("decoded", rows.columns)
    asked = rows.select(*own, F.col(ids_col).cast("array<int>").alias(fresh("ids_of", own)))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.select(*own).schema), T.StructField(made, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                lists = batch.column(len(own))
                texts = decode(pieces, pa.array(lists.to_pylist(), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.binary())], [*own, made])

    return asked.mapInArrow(run, schema).select(*own, F.decode(made, "UTF-8").alias(out_col))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_documents(docs).select("doc_id", "n_ids", "ids", "round_trip", "decoded_crc32")


SQL: dict[str, str] = {}
