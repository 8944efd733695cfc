"""Hashed character n-grams of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters worked on at a time, so that memory does not follow a text's length.
SLICE = 1 << 20


@cache
def letters(digits: bool) -> np.ndarray:
    """Whether each code point is a letter (or digit)."""
    test = str.isalnum if digits else str.isalpha
    return np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def slices(text: str, digits: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points in lower case, other characters than letters as blanks; whether each is one; windows that start here).

    A blank stands before and after the text. Slices overlap by ``most`` - 1
    characters, so every window of up to ``most`` characters starts in one slice.
    """
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    for a in range(0, len(c), SLICE):
        part = c[a : a + SLICE + most - 1]
        w = letters(digits)[part]
        yield np.where(w, part, np.uint32(32)), w, min(SLICE, len(c) - a)


def hashed(c: np.ndarray, w: np.ndarray, starts: int, least: int, most: int, bits: int, inside: bool) -> Iterator[np.ndarray]:
    """Bucket numbers of the windows of ``least`` to ``most`` characters.

    inside: only windows within a word and the blanks beside it; else all that do not begin with two blanks.
    """
    h = np.zeros(len(c), dtype=np.uint32)
    ok = np.ones(len(c), dtype=bool)
    for n in range(1, most + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + c[n - 1 :]
        if n >= 3:
            ok = ok[:m] & w[n - 2 : n - 2 + m]
        if n < least:
            continue
        top = min(m, starts)
        mixed = (h[:top] ^ (h[:top] >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        ids = (mixed >> np.uint32(32 - bits)).astype(np.int32)
        if inside:
            yield ids[ok[:top]]
        elif n == 1:
            yield ids[w[:top]]
        else:
            yield ids[w[:top] | w[1 : top + 1]]


def counts(text: str | None, least: int, most: int, bits: int, inside: bool, digits: bool) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    out = np.zeros(1 << bits, dtype=np.int64)
    if text:
        for c, w, starts in slices(text, digits, most):
            for ids in hashed(c, w, starts, least, most, bits, inside):
                out += np.bincount(ids, minlength=1 << bits)
    return out


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a missing id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def held(id_col: str, folds: int, which: int) -> Column:
    return fold(id_col, folds) == which


def bounded_sample(rows: DataFrame, id_col: str, label_col: str, per_label: dict, seed: int = 3) -> DataFrame:
    """About ``per_label[label]`` rows of each label, chosen by a hash of the id; all of them if there are fewer.

    The labels' row counts are taken over all rows; the driver sees only those.
    """
    total = {r[0]: r[1] for r in rows.where(F.col(label_col).isin(list(per_label))).groupBy(label_col).count().collect()}
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    keep = F.lit(False)
    for label, most in per_label.items():
        share = min(1.0, most / max(1, total.get(label, 0)))
        keep = keep | ((F.col(label_col) == label) & (place < int(share * (1 << 30))))
    return rows.where(keep).limit(2 * sum(per_label.values()) + 1000)
