"""Kernels on whole batches of reads where column expressions don't reach: low-complexity masks and overlapping mates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions.sequence import _FLIP

_CODE = np.full(256, 4, np.int64)
_CODE[[65, 67, 71, 84]] = range(4)


def low_complexity(seqs: list[str], window: int = 64, threshold: float = 2.0) -> Iterator[np.ndarray]:
    """Which bases symmetric DUST masks: the union of its perfect intervals, of at most `window` bases.

    An interval of l triplets scores (pairs of equal triplets) / (l - 1); it is perfect if that is above the threshold and
    no interval inside scores higher. Pairs of an interval follow from its three smaller ones, so one pass for each l does
    all intervals of all reads. A letter other than ACGT is a fifth symbol.
    """
    raw = np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)
    size = np.array([len(s) for s in seqs], np.int64)
    end = np.cumsum(size)
    masked = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 2:
        code = _CODE[raw]
        triplet = code[:-2] * 25 + code[1:-1] * 5 + code[2:]
        room = np.repeat(end, size)[: len(triplet)] - np.arange(len(triplet)) - 2  # triplets left in the read
        n = len(triplet)
        before, last = np.zeros(n, np.int64), np.zeros(n, np.int64)  # pairs of l - 2 and of l - 1 triplets
        best = np.zeros(n)
        for length in range(2, window - 1):
            m = n - length + 1
            if m <= 0:
                break
            pairs = last[:m] + last[1 : m + 1] - before[1 : m + 1] + (triplet[:m] == triplet[length - 1 :])
            score = np.where(room[:m] >= length, pairs / (length - 1), 0.0)
            inside = np.maximum(best[:m], best[1 : m + 1])
            perfect = np.flatnonzero((score > threshold) & (score >= inside))
            np.add.at(masked, perfect, 1)
            np.add.at(masked, perfect + length + 2, -1)
            best = np.maximum(score, inside)
            before, last = last[:m], pairs
    covered = np.cumsum(masked)[:-1] > 0
    for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
        yield covered[a:b]


def _parts(texts: list[str], bases: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, a list closed once it has so many bases: memory follows it, not the batch."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= bases:
            yield part
            part, n = [], 0
    yield part


def dust(seq: Column) -> Column:
    """The sequence with low-complexity bases as N; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        texts = [x or "" for x in s]
        out = []
        for old, text, mask in zip(s, texts, (m for part in _parts(texts) for m in low_complexity(part)), strict=True):
            a = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).copy()
            a[mask] = 78
            out.append(None if old is None else a.tobytes().decode("latin-1"))
        return pd.Series(out, dtype=object)

    return run(seq)


def overlaps(first: np.ndarray, second: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start in first, bases) of every overlap of first's end with second that agrees well enough: 95 % below 50 bases, 85 to 95 % below 100, else 85 %."""
    n, m = len(first), len(second)
    found = []
    for start in range(max(n - least, 0)):
        span = n - start
        share = 0.85 if span >= 100 else 0.85 + (span - 50) / 500 if span >= 50 else 0.95
        bases = min(span, m)
        # the part of the span beyond second's end counts for the overlap
        if int((first[start : start + bases] == second[:bases]).sum()) + (span - bases) >= int(span * share):
            found.append((start, bases))
    return found


def repeats_itself(seq: np.ndarray) -> bool:
    """Whether whole copies of a shorter unit, at least two, fill the sequence but for a rest."""
    n = len(seq)
    return any((seq[: n // unit * unit].reshape(-1, unit) == seq[:unit]).all() for unit in range(1, n // 2 + 1))


def merge_pair(r1: str, q1: str | None, r2: str | None, q2: str | None) -> tuple[int, str | None, str | None]:
    """(kind, bases, qualities): 2 where mates read through the fragment, 1 where their ends overlap, 0 where they don't, or it is ambiguous."""
    if not r1 or not r2:
        return 0, None, None
    back = "".join(c if c in "ACGT" else "N" for c in r2).translate(_FLIP)[::-1]
    a, b = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (r1, back))
    known = q1 is not None and q2 is not None
    qa, qb = (np.frombuffer(x.encode("latin-1"), np.uint8).astype(int) for x in (q1, q2[::-1])) if known else (None, None)
    least = min(31, (len(a) + len(b)) // 10)
    through = overlaps(b, a, least)
    if len(through) == 1:
        start, n = through[0]
        base, qual = a[:n].copy(), None
        if known:
            other = (qb[start : start + n] > qa[:n]) | (base == 78)
            base = np.where(other, b[start : start + n], base)
            qual = np.where(other, qb[start : start + n], qa[:n])
        return 2, *_texts(base, qual)
    ends = overlaps(a, b, least)
    if len(ends) != 1 or (ends[0][1] <= 2 * least and repeats_itself(b[: ends[0][1]])):
        return 0, None, None
    start, _ = ends[0]
    total = start + len(b)
    n = min(len(a), total)
    base = np.concatenate([a[:start], b])
    mine = (np.arange(n) < start) | (base[:n] == 78)
    qual = None
    if known:
        qual = np.concatenate([qa[:start], qb])
        mine |= qa[:n] >= qual[:n] - 14
        qual[:n] = np.where(mine, qa[:n], qual[:n])
    base[:n] = np.where(mine, a[:n], base[:n])
    return 1, *_texts(base, qual)


def _texts(base: np.ndarray, qual: np.ndarray | None) -> tuple[str, str | None]:
    return base.astype(np.uint8).tobytes().decode("latin-1"), None if qual is None else qual.astype(np.uint8).tobytes().decode("latin-1")


def merged_mates(r1: Column, q1: Column, r2: Column, q2: Column) -> Column:
    """A struct (kind, seq, qual) of each pair."""

    @F.pandas_udf("kind int, seq string, qual string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merge_pair(*x) for x in zip(a, b, c, d, strict=True)], columns=["kind", "seq", "qual"])

    return run(r1, q1, r2, q2)
