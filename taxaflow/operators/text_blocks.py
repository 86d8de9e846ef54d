"""A text dealt out in blocks, and exact lookups of strings in it.

A block holds its own bases, those before it that a read can reach back to, and a few after it. Every place in a block is
named by the letters before it, packed into 64 bits with the nearest letter on top. In the order of these names the strings
that end alike are neighbours, so the longest string of a block that ends like a read is next to the read's own name; what
agrees in all packed letters is followed back letter by letter. No task holds more than a block and a portion of reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.storage import stored

PAIRS = 1 << 20


class Codes:
    """Letters as small numbers: 0 is outside the text, a letter that no text holds has all bits set."""

    def __init__(self, letters: bytes, bits: int):
        self.bits, self.most = bits, 63 // bits
        self.of = np.full(256, (1 << bits) - 1, np.uint64)
        self.of[list(letters)] = range(1, len(letters) + 1)
        self.of[ord("$")] = len(letters) + 1  # the mark after a protein

    def names(self, codes: np.ndarray) -> np.ndarray:
        """For every place 0 .. n, the letters before it."""
        n = len(codes)
        out = np.zeros(n + 1, np.uint64)
        for j in range(1, min(self.most, n) + 1):
            out[j:] |= codes[: n + 1 - j] << np.uint64(self.bits * (self.most - j))
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the packed letters agree, from the nearest on."""
        unlike = a ^ b
        out = np.zeros(len(unlike), np.int64)
        for j in range(1, self.most + 1):
            out += unlike >> np.uint64(self.bits * (self.most - j)) == 0
        return out


def dealt(text: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(block, first, bases, starts, seqs): bases from `before` before a block's own to `after` behind them; the genomes they are from."""
    end = F.col("start") + F.length("bases")
    low, high = F.greatest(F.floor((F.col("start") - after) / size), F.lit(0)), F.floor((end - 1 + before) / size)
    last = text.agg(F.max(F.floor((end - 1) / size)).alias("last"))
    rows = text.select("seq", "start", F.col("bases").cast("binary").alias("bases")).crossJoin(F.broadcast(last)).withColumn("block", F.explode(F.sequence(low, F.least(high, F.col("last")))))
    a = F.greatest(F.col("start"), F.col("block") * size - before)
    n = F.least(end, (F.col("block") + 1) * size + after) - a
    rows = rows.select("block", "seq", "start", a.alias("at"), F.substring("bases", (a - F.col("start") + 1).cast("int"), n.cast("int")).alias("bases")).where(F.length("bases") > 0)

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        starts, seqs = (group.column(c).to_numpy().astype("<i8").tobytes() for c in ("start", "seq"))
        return pa.table([pa.array([group.column("block")[0].as_py()], pa.int64()), pa.array([group.column("at")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in (b"".join(group.column("bases").to_pylist()), starts, seqs))], names=["block", "first", "bases", "starts", "seqs"])

    rows = rows.select("block", F.col("seq").cast("long"), F.col("start").cast("long"), F.col("at").cast("long"), "bases")
    return rows.groupBy("block").applyInArrow(joined, "block long, first long, bases binary, starts binary, seqs binary")


class Block:
    """A block's places in the order of their names; only its own can be ends of strings."""

    def __init__(self, group: pa.Table, codes: Codes, size: int):
        no, self.first = group.column("block")[0].as_py(), group.column("first")[0].as_py()
        text = np.frombuffer(group.column("bases")[0].as_py(), np.uint8)
        self.codes, self.names = codes, codes.names(codes.of[text])
        self.low = max(no * size - self.first, 0) + 1
        own = self.names[self.low : (no + 1) * size - self.first + 1]
        self.order = np.argsort(own)
        self.sorted = own[self.order]

    def pairs(self, left: np.ndarray, right: np.ndarray):
        """(which range, place) of all that the ranges of the order hold, some at a time."""
        total = np.cumsum(right - left)
        done, whole = 0, int(total[-1]) if len(total) else 0
        while done < whole:
            n = np.arange(done, min(done + PAIRS, whole))
            which = np.searchsorted(total, n, side="right")
            yield which, self.order[right[which] - (total[which] - n)] + self.low
            done += PAIRS

    def lengths(self, names: np.ndarray) -> np.ndarray:
        """The longest string before each place of the reads that is in the text before an own place."""
        most = self.codes.most
        if not len(self.sorted):
            return np.zeros(len(names), np.int64)
        some, back = np.unique(names, return_inverse=True)
        at = np.searchsorted(self.sorted, some)
        best = np.maximum(self.codes.common(some, self.sorted[np.maximum(at - 1, 0)]), self.codes.common(some, self.sorted[np.minimum(at, len(self.sorted) - 1)]))
        out = best[back]
        full = np.flatnonzero(out == most)
        for which, place in self.pairs(at[back[full]], np.searchsorted(self.sorted, some[back[full]], side="right")):
            end = full[which]
            length, to, go = np.full(len(end), most), end, np.arange(len(end))
            while len(go):
                place, to = place - most, to - most
                more = self.codes.common(self.names[np.maximum(place, 0)], names[np.maximum(to, 0)])
                length[go] += more
                on = more == most
                go, place, to = go[on], place[on], to[on]
            np.maximum.at(out, end, length)
        return out

    def occurrences(self, names: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        """(which string, where it ends) of strings that end at places of a buffer with these names."""
        most, bits = self.codes.most, self.codes.bits
        tail = np.minimum(sizes, most)
        shift = (bits * (most - tail)).astype(np.uint64)
        low = names[ends] >> shift << shift
        for which, place in self.pairs(np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + (np.uint64(1) << shift))):
            same, go, deep = np.ones(len(which), bool), np.flatnonzero(sizes[which] > most), most
            while len(go):
                rest = np.minimum(sizes[which[go]] - deep, most)
                equal = self.codes.common(self.names[np.maximum(place[go] - deep, 0)], names[np.maximum(ends[which[go]] - deep, 0)]) >= rest
                same[go[~equal]] = False
                deep += most
                go = go[equal & (sizes[which[go]] > deep)]
            yield which[same], place[same]


def longest(blocks: DataFrame, chunks: DataFrame, codes: Codes, width: int, size: int, fan: int = 64) -> DataFrame:
    """(chunk, lengths): for every end in a portion's strings, a line each, the length of the longest string before it that is in the text; below width 0."""

    def of_block(group: pa.Table) -> pa.Table:
        strings = np.frombuffer(b"\n" * codes.most + group.column("strings")[0].as_py() + b"\n", np.uint8)
        found = Block(group, codes, size).lengths(codes.names(codes.of[strings]))[codes.most : -1]
        blob = np.where(found < width, 0, found).astype("<u4").tobytes()
        return pa.table([group.column("chunk"), group.column("block"), pa.array([blob], pa.binary())], names=["chunk", "block", "lengths"])

    def most(group: pa.Table) -> pa.Table:
        out = np.frombuffer(group.column("lengths")[0].as_py(), "<u4").copy()
        for x in group.column("lengths"):
            np.maximum(out, np.frombuffer(x.as_py(), "<u4"), out=out)
        return pa.table([group.column(c).slice(0, 1) for c in ("chunk", "block")] + [pa.array([out.tobytes()], pa.binary())], names=["chunk", "block", "lengths"])

    kinds = "chunk long, block long, lengths binary"
    out = blocks.crossJoin(chunks).groupBy("chunk", "block").applyInArrow(of_block, kinds)
    left = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    while left > 1:  # a task combines so many at once, however many blocks there are
        out = out.withColumn("block", F.floor(F.col("block") / fan)).groupBy("chunk", "block").applyInArrow(most, kinds)
        left = -(-left // fan)
    return out.select("chunk", "lengths")


def picked(r: Column, n: Column, most: int) -> Column:
    """Whether row r of n is looked at: every step-th from the front, then from the back until there are enough."""
    step = F.ceil(n / most)
    back = F.floor((n - 1 - r) / step)
    return (r % step == 0) | (((n - 1 - r) % step == 0) & ((back == 0) | (F.ceil(n / step) + back < most)))


def owners(blocks: DataFrame, strings: DataFrame, codes: Codes, width: int, size: int, most: int) -> DataFrame:
    """(name, seq, occurrences) of strings (name, string): the sequences they occur in; of more than `most` occurrences (0: no limit), those of some rows of the suffix order."""

    def packed(batches):
        for batch in batches:
            names, values = (batch.column(i).to_pylist() for i in (0, 1))
            at, used = 0, 0
            for i, s in enumerate(values, 1):
                used += len(s)
                if used >= 1 << 19 or i == len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (",".join(names[at:i]).encode(), b"\n".join(values[at:i]))], names=["names", "strings"])
                    at, used = i, 0

    def of_block(group: pa.Table) -> pa.Table:
        block = Block(group, codes, size)
        starts, seqs = (np.frombuffer(group.column(c)[0].as_py(), "<i8") for c in ("starts", "seqs"))
        keys, own = group.column("names")[0].as_py().decode().split(","), group.column("strings")[0].as_py()
        sizes = np.array([len(s) for s in own.split(b"\n")])
        buffer = np.frombuffer(b"\n" * codes.most + own, np.uint8)
        ends = codes.most + np.cumsum(sizes + 1) - 1
        found = list(block.occurrences(codes.names(codes.of[buffer]), ends, sizes))
        which, end = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        place = end + block.first - sizes[which]
        at = np.maximum(np.searchsorted(starts, place + width + 1, side="right") - 1, 0)
        return pa.table([pa.array([keys[i] for i in which.tolist()], pa.string()), pa.array(place, pa.int64()), pa.array(sizes[which], pa.int64()), pa.array(seqs[at], pa.int64())], names=["name", "place", "length", "seq"])

    pieces = blocks.crossJoin(strings.mapInArrow(packed, "names binary, strings binary"))
    found = stored(pieces.groupBy("block", F.sha2("names", 256)).applyInArrow(of_block, "name string, place long, length long, seq long"))
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("occurrences"))
    found = found.join(counts, "name")
    if not most:
        return found.select("name", "seq", "occurrences").distinct()
    few = found.where(F.col("occurrences") <= most).select("name", "seq", "occurrences")
    many = _ranked(blocks, found.where(F.col("occurrences") > most), size, most).where(picked(F.col("r"), F.col("occurrences"), most))
    return few.unionByName(many.select("name", "seq", "occurrences")).distinct()


def _cut(size: int, width: int):
    """What a block has of the `width` letters from each place a."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            no, first, text = (right.column(x)[0].as_py() for x in ("block", "first", "bases"))
            out = [text[max(a, no * size) - first : min(a + width, (no + 1) * size) - first] for a in left.column("a").to_pylist()]
        kept = left if out else left.slice(0, 0)
        return pa.table([*(kept.column(x) for x in ("name", "place", "block")), pa.array(out, pa.binary())], names=["name", "place", "block", "bases"])

    return cut


def _ranked(blocks: DataFrame, rows: DataFrame, size: int, most: int) -> DataFrame:
    """rows with r, their place in the suffix order of their name's; r is that of the first of its equals where none or all of them are picked.

    What follows the string is compared a stretch at a time, only where rows are still alike and only some of them are picked.
    """
    alike = W.partitionBy("name", "r")
    n, r, c = F.col("occurrences"), F.col("r"), F.col("c")
    step = F.ceil(n / most)
    last = F.greatest(most - F.ceil(n / step) - 1, F.lit(0))
    none = (F.ceil((r + c) / step) == F.ceil(r / step)) & (F.ceil((n - r - c) / step) > F.least(F.floor((n - 1 - r) / step), last))
    rows = stored(rows.withColumn("r", F.lit(0).cast("long")).withColumn("c", n).withColumn("open", F.col("c") > 1))
    at, width = 0, 64
    while not rows.where("open").isEmpty():
        a = F.col("place") + F.col("length") + at
        spans = rows.where("open").select("name", "place", a.alias("a"), F.explode(F.sequence(F.floor(a / size), F.floor((a + width - 1) / size))).alias("block"))
        parts = spans.groupBy("block").cogroup(blocks.select("block", "first", "bases").groupBy("block")).applyInArrow(_cut(size, width), "name string, place long, block long, bases binary")
        keys = parts.groupBy("name", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "bases"))), lambda x: x["bases"].cast("string")), "").alias("key"))
        known = rows.where("open").join(keys, ["name", "place"], "left").withColumn("key", F.coalesce("key", F.lit("")))
        known = known.withColumn("r", r + F.rank().over(alike.orderBy("key")) - 1).drop("key").withColumn("c", F.count(F.lit(1)).over(alike))
        known = known.withColumn("open", (c > 1) & ~none)
        rows = stored(known.unionByName(rows.where("not open")))
        at, width = at + width, min(width * 4, 1 << 20)
    return rows
