"""Maximal-exact-match search of reads in a genome text.

The text is all genomes end to end, letters outside the alphabet dropped. A read is scanned from its end: the longest
suffix of what remains that occurs in the text is a hit if it is long enough, and the scan goes on one base before it; a
suffix whose last `width` bases don't occur is skipped by `width`. Both strands are scanned, and hits of the two that
overlap but disagree on an end are reconciled. Protein texts hold a sequence mark after each protein and are searched with
the reading frame that scores best on each strand.

The text is never in one place: search() deals it out in blocks (text_blocks.py), finds for every end in a read the
longest string of any block, scans with these lengths, and then looks up where the hits occur. Index is the same search
with a suffix array in memory, for small texts.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.sequence import CODE
from taxaflow.operators import text_blocks as B
from taxaflow.storage import stored

WIDTH = 10
PROTEIN_WIDTH = 4
PROTEIN_ADJUST = 5
# Letters of a protein text.
AMINO = "ARNDCEQGHILKMFPSTWYV"
HITS = "read long, strand int, hit int, seq long, offset int, length int, occurrences long"
_FLIP = str.maketrans("ACGT", "TGCA")
_CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), CODE, strict=True)}


def genome_text(genomes: DataFrame, width: int = WIDTH, protein: bool = False) -> DataFrame:
    """(seq, bases, start): kept letters of each genome and where it starts; genomes not longer than width are dropped. genomes: seq (their order), bases; rows of one seq follow each other by file_no and read_no if they have them. A protein ends with a mark that no read holds, which counts for its length."""
    letters = F.regexp_replace("bases", f"[^{AMINO}]" if protein else "[^ACGT]", "")
    order = ["seq", *(c for c in ("file_no", "read_no") if c in genomes.columns)]  # a seq may have several rows
    kept = genomes.select(*order, (F.concat(letters, F.lit("$")) if protein else letters).alias("bases")).where(F.length("bases") > width)
    # prefix sums in two levels: within ranges of seq, then over the ranges
    parts = kept.select(*order, "bases", F.length("bases").cast("long").alias("n")).withColumn("part", F.floor(F.col("seq") / 100_000))
    sums = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = sums.withColumn("base", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inner = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("inner", inner).join(before, "part").select("seq", "bases", (F.col("inner") + F.col("base")).alias("start"))


def suffix_array(text: bytes) -> np.ndarray:
    """By prefix doubling."""
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n and k < n:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.append(0, np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


@dataclass
class Match:
    """A string of the text found on one strand: its offset from that strand's end, its length, its rows of the suffix order."""

    offset: int
    length: int
    low: int
    high: int


def reconcile(plus: list[Match], minus: list[Match], read: bytes, back: bytes, longest: Callable[[bytes, int], tuple[int, int, int]]) -> None:
    """Lets hits of two strands agree on their ends, in place. Both scans start at their own strand's end and go on one base
    before each hit, so a chance hit there can shift the border of the true one.

    On the read, both lists are walked from right to left. Where two hits overlap and neither holds the other, the one that
    ends earlier in its own direction is searched again from the other's end and replaced if it then spans exactly what both
    cover together. Hits of a strand that a replacement made overlap are cut in the end.
    """
    n = len(read)
    changed = [False, False]
    at = len(minus) - 1
    for i, hit in enumerate(plus):
        right = n - 1 - hit.offset
        left = right - hit.length + 1
        while at >= 0:
            other = minus[at]
            first, last = other.offset, other.offset + other.length - 1
            if first < right:
                equal = (first, last) == (left, right)
                nested = first < left and right < last or left < first and last < right
                if last <= left or equal or nested:
                    break
                if last > right:
                    length, low, high = longest(read, last + 1)
                    if length == last - left + 1 and low < high:
                        plus[i] = Match(n - 1 - last, length, low, high)
                        changed[0] = True
                if left < first:
                    length, low, high = longest(back, n - left)
                    if length == last - left + 1 and low < high:
                        minus[at] = Match(left, length, low, high)
                        changed[1] = True
            at -= 1
    for hits, cut in zip((plus, minus), changed, strict=True):
        if cut:
            separate(hits)


def separate(hits: list[Match]) -> None:
    """Cuts overlaps of a strand's hits, in place: the longer of two keeps the overlap, the later one if they are equal; one inside a longer hit keeps nothing."""
    for i, hit in enumerate(hits):
        end = hit.offset + hit.length
        for later in hits[i + 1 :]:
            if later.offset >= end:
                break
            if hit.length <= later.length:
                hit.length = later.offset - hit.offset
                break
            beyond = later.offset + later.length - end
            if beyond > 0:
                later.offset, later.length = end, beyond
                break
            later.length = 0


def frames(read: str) -> list[bytes]:
    """Amino acids of the three forward frames; a codon with another letter than ACGT is ?."""
    return ["".join(_CODONS.get(read[i : i + 3], "?") for i in range(f, len(read) - 2, 3)).encode() for f in range(3)]


def flipped(read: str) -> str:
    return "".join(c if c in "ACGT" else "N" for c in read).translate(_FLIP)[::-1]


class Scan:
    """Reads scanned by longest_suffix(read, end), which gives (length, low, high): low < high if a string of the text was found."""

    longest_suffix: Callable[[bytes, int], tuple[int, int, int]]

    def scan(self, s: bytes, least: int) -> list[Match]:
        found, end = [], len(s)
        while end >= least:
            length, low, high = self.longest_suffix(s, end)
            if length >= least and low < high:
                found.append(Match(len(s) - end, length, low, high))
            end -= length + 1
        return found

    def best_frame(self, read: str, least: int, adjust: int) -> tuple[list[Match], bytes]:
        """Hits of the frame with the highest score times number of hits, the first of equal ones, and the frame."""
        return max(((self.scan(f, least), f) for f in frames(read)), key=lambda x: len(x[0]) * sum((h.length - adjust) ** 2 for h in x[0]))

    def matches(self, read: str, least: int, protein: bool = False, agree: bool = True) -> Iterator[tuple[int, int, Match, bytes]]:
        """(strand, hit, match, what was scanned)."""
        back = flipped(read)
        if protein:
            both, scanned = zip(*(self.best_frame(s, least, PROTEIN_ADJUST) for s in (read, back)), strict=True)
        else:
            scanned = read.encode("latin-1", "replace"), back.encode()
            both = [self.scan(s, least) for s in scanned]
            if agree:
                reconcile(*both, *scanned, self.longest_suffix)
        for strand, found, s in zip((1, -1), both, scanned, strict=True):
            for k, m in enumerate(h for h in found if h.length >= least):
                yield strand, k, m, s


class Lengths(Scan):
    """A scan by the lengths that are known of every end; low of a match is that end."""

    def __init__(self, known: dict[bytes, np.ndarray], width: int, letters: bytes):
        self.known, self.width, self.letters = known, width, letters

    def longest_suffix(self, read: bytes, end: int) -> tuple[int, int, int]:
        if end < self.width:
            return 0, 0, 0
        length = int(self.known[read][end])
        if length >= self.width:
            return length, end, end + 1
        return next((i for i in range(self.width) if read[end - i - 1] not in self.letters), self.width - 1), 0, 0


class Index(Scan):
    def __init__(self, text: bytes, starts: list[int], seqs: list[int], width: int = WIDTH, letters: bytes = b"ACGT"):
        self.text, self.starts, self.seqs, self.width, self.letters = text, starts, seqs, width, letters
        self.order = suffix_array(text).tolist()

    def range_of(self, word: bytes, low: int = 0, high: int | None = None) -> tuple[int, int]:
        text, order, n = self.text, self.order, len(word)
        low, high = 0, len(order)
        a, b = low, high
        while a < b:
            m = (a + b) // 2
            if text[order[m] : order[m] + n] < word:
                a = m + 1
            else:
                b = m
        start, b = a, high
        while a < b:
            m = (a + b) // 2
            if text[order[m] : order[m] + n] <= word:
                a = m + 1
            else:
                b = m
        return start, a

    def longest_suffix(self, read: bytes, end: int) -> tuple[int, int, int]:
        """(length, rows of the suffix order) of the longest suffix of read[:end] in the text; fewer than width bases when a letter or the last word isn't there."""
        w = self.width
        if end < w:
            return 0, 0, 0
        for i in range(1, w + 1):
            if read[end - i] not in self.letters:
                return i - 1, 0, 0
        low, high = self.range_of(read[end - w : end])
        if low >= high:
            return w - 1, 0, 0
        good, most = w, end
        for i in range(w, end):
            if read[end - i - 1] not in self.letters:
                most = i
                break
        rows = (low, high)
        bad = most + 1
        while good + 1 < bad:
            m = (good + bad) // 2
            r = self.range_of(read[end - m : end])
            if r[0] < r[1]:
                good, rows = m, r
            else:
                bad = m
        return good, *rows

    def owners(self, low: int, high: int, most: int) -> set[int]:
        """Sequences of the occurrences; above `most`, every step-th from the front, then from the back until there are enough."""
        n = high - low
        if most and n > most:
            step = -(-n // most)
            rows = list(range(low, high, step))
            back = high - 1
            while True:
                rows.append(back)
                back -= step
                if len(rows) >= most or back < low:
                    break
        else:
            rows = range(low, high)
        found = set()
        for r in rows:
            found.add(self.seqs[max(0, bisect_right(self.starts, self.order[r] + self.width + 1) - 1)])
        return found

    def hits(self, read: str, least: int, most: int, protein: bool = False, agree: bool = True) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(strand, hit, seq, offset from the read's end, length, occurrences in the text)."""
        for strand, k, m, _ in self.matches(read, least, protein, agree):
            for seq in sorted(self.owners(m.low, m.high, most)):
                yield strand, k, seq, m.offset, m.length, m.high - m.low


def search(reads: DataFrame, text: DataFrame, least: int, k: int = 1, factor: int = 40, protein: bool = False, agree: bool = True, block: int = 1 << 20) -> DataFrame:
    """Hits of reads (read, seq) in a genome_text(). protein: of a protein text, by translated reads, in amino acids. agree: hits of both strands are reconciled (never with protein). block: bases of the text that one task holds."""
    width, letters = (PROTEIN_WIDTH, AMINO.encode()) if protein else (WIDTH, b"ACGT")
    codes = B.Codes(letters, 5 if protein else 3)
    names = [x.split()[0] for x in HITS.split(", ")]
    chunks = stored(reads.select(F.col("read").cast("long"), "seq").withColumn("part", F.spark_partition_id()).mapInArrow(lambda batches: _chunks(batches, protein), "chunk long, strings binary, reads binary"))
    longest = chunks.agg(F.max(F.expr("aggregate(transform(split(decode(strings, 'ISO-8859-1'), '\n'), x -> length(x)), 0, (a, x) -> greatest(a, x))"))).first()[0]
    if not longest:
        return reads.sparkSession.createDataFrame([], HITS)
    blocks = stored(B.dealt(text, block, longest, width + 2))
    lengths = B.longest(blocks, chunks.select("chunk", "strings"), codes, width, block)

    def scanned(group: pa.Table) -> pa.Table:
        own = group.column("strings")[0].as_py().split(b"\n")
        values = np.frombuffer(group.column("lengths")[0].as_py(), "<u4")
        ends = np.cumsum([len(s) + 1 for s in own]).tolist()
        index = Lengths({s: values[e - len(s) - 1 : e] for s, e in zip(own, ends, strict=True)}, width, letters)
        rows = []
        for read, s in pickle.loads(group.column("reads")[0].as_py()):
            for strand, hit, m, string in index.matches(s, least, protein, agree):
                rows.append((read, strand, hit, m.offset, m.length, string[m.low - int(index.known[string][m.low]) : m.low]))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["read", "strand", "hit", "offset", "length", "string"])

    found = chunks.join(lengths, "chunk").groupBy("chunk").applyInArrow(scanned, "read long, strand int, hit int, offset int, length int, string binary")
    found = stored(found.withColumn("name", F.sha2("string", 256)))
    owners = B.owners(blocks, found.select("name", "string").dropDuplicates(["name"]), codes, width, block, k * factor)
    return found.join(owners, "name").select(*names)


def _chunks(batches: Iterator[pa.RecordBatch], protein: bool, bases: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Reads in portions: what is to be scanned of them, each string once, and the reads themselves."""
    have: list[tuple[int, str]] = []
    no = size = 0
    for batch in batches:
        for read, seq, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have.append((read, "".join(c if c in "ACGT" else "N" for c in seq or "")))
            size += len(have[-1][1])
            if size >= bases:
                yield _chunk((part << 32) + no, have, protein)
                have, no, size = [], no + 1, 0
    if have:
        yield _chunk((part << 32) + no, have, protein)


def _chunk(key: int, reads: list[tuple[int, str]], protein: bool) -> pa.RecordBatch:
    strings = sorted({x for _, s in reads for t in (s, flipped(s)) for x in (frames(t) if protein else [t.encode()])})
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([b"\n".join(strings)], pa.binary()), pa.array([pickle.dumps(reads)], pa.binary())], names=["chunk", "strings", "reads"])
