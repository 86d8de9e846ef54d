"""N-gram Jaccard join by token-combination prefixes: documents whose sets of k-word shingles have Jaccard >= num / den.

link_components() (op7) takes 3 words and 90 %, keep_one() (the pipeline) 5 words and 80 %. The text below writes 0.9.

Tokens are 64-bit hashes of k-word shingles. A fixed-size table of counts over all documents (2^22 cells, whatever the
corpus) orders them: rare cells first, ties by hash. Any one order is right; counts only make it selective.

Two sets that link share at least two tokens among the first n - ceil(0.9 n) + 2 of each (the extended prefix). Tokens of
the rare class are indexed alone; tokens of the frequent class only as pairs. If one of the two shared tokens is rare, it
is a common key; if both are frequent, their pair is. Every other pair of sets is never looked at.

A node is a set, named by 128 bits over its tokens' two hashes, so copies are never joined. The nodes under a key form a
group; equal groups are one. A key whose tokens are very frequent is split by node, so that no task holds all its nodes,
and the parts form a family. Members of a group meet in blocks. Where many pairs may link, only each member's nearest
and the pairs of the member with most are given out; after components are formed from verified links, such a group comes
back as long as it holds several components, and when a round brings no link, with all pairs between them. Sizes and sketches (parities of token counts by cell) drop what
can't link before anything is verified: members without a possible partner already where a group is gathered. A group of near copies so costs its size, not its square, and no link
between components is lost.

Verification reads the texts of the pairs left, found again in the documents behind a bitmap of the ids asked for (8 MB,
whatever the corpus), and compares shingles by their words: no hash decides a link.

Null text has an empty set. Empty sets and rows without doc_id link with nothing (component_id is their doc_id). Rows
with one doc_id are nodes of their own and get a row each; repeated rows are one node. An empty table gives no rows.
Columns other than doc_id and text are not looked at, whatever their names.

What a mixed family of m distinct sets costs: m / 2048 sketches a member. A document with f tokens of the frequent class
in its prefix indexes f (f - 1) / 2 pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.llm.common import byte_codes, ensure_checkpoint_dir, mix, parts_for, slices, utf8_buffers, word_bounds
from taxaflow.llm.components import connected_components
from taxaflow.llm.windows import pack, unpack

CELLS = 22
PIECES = 16
BLOCK = 2048
#: Candidate pairs a member that a group gives out at once.
LIMIT = 4
#: Bits of the bitmap of documents asked for.
ASKED = 26
#: Groups of so many members that share their least node are united.
UNITE = 64
#: About as many nodes of one key meet in a task; keys expected to hold more are split.
HOT = 1 << 15


def lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens in order, a second hash of each) of each text, distinct: A-Z in lower case; a text of fewer than k words has its whole sequence."""
    raw = lowered(raw)
    start, end, doc = word_bounds(raw, off)
    low, high = byte_codes(raw, start, end - start)
    bounds = np.searchsorted(doc, np.arange(len(off))).tolist()
    with np.errstate(over="ignore"):
        one, two = mix(low ^ mix(high + np.uint64(1))), mix(high ^ mix(low + np.uint64(0xD6E8FEB86659FD93)))
        g, h = np.zeros(len(one), np.uint64), np.zeros(len(one), np.uint64)
        n = len(one)
        for i in range(min(k, n)):
            g[: n - i] = mix(g[: n - i] * np.uint64(0x9E3779B97F4A7C15) + one[i:])
            h[: n - i] = mix(h[: n - i] * np.uint64(0xA24BAED4963EE407) + two[i:])
        out = []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y - x >= k:
                s, t = g[x : y - k + 1], h[x : y - k + 1]
                order = np.argsort(s, kind="stable")
                s, t = s[order], t[order]
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                if (t[1:] != t[:-1])[~keep[1:]].any():  # two shingles of one first hash
                    order = np.lexsort((t, s))
                    s, t = s[order], t[order]
                    keep[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                out.append((s[keep], t[keep]))
            elif y > x:
                a, b = np.uint64(y - x), np.uint64(y - x)
                for w, v in zip(one[x:y], two[x:y], strict=True):
                    a, b = mix(a * np.uint64(0x9E3779B97F4A7C15) + w), mix(b * np.uint64(0xA24BAED4963EE407) + v)
                out.append((np.array([a], np.uint64), np.array([b], np.uint64)))
            else:
                out.append((g[:0], h[:0]))
    return out


def shingle_words(text: bytes, k: int) -> set[bytes]:
    """The set by its words, each shingle joined by one blank."""
    raw = lowered(np.frombuffer(text, np.uint8))
    start, end, _ = word_bounds(raw, np.array([0, len(raw)]))
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def node_of(tokens: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(tokens[0].tobytes() + tokens[1].tobytes(), digest_size=16).digest()


def room_of(total: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """In how many tokens two linked sets of `total` tokens together may differ."""
    return total - 2 * -(-total * num // (num + den))


def sketch_of(tokens: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the numbers of tokens by cell: two sets differ in at least as many tokens as their parities differ. The number of cells, a power of two, grows with what a linked pair may differ in; halves of a sketch add up to the sketch of half as many cells."""
    cells = 256
    while cells < 16 * room_of(2 * len(tokens), num, den):
        cells *= 2
    count = np.bincount(((tokens >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def small_sketch(tokens: np.ndarray, num: int, den: int) -> bytes:
    """A sketch for postings: a few bits for each token that a linked pair may differ in, 128 to 2048."""
    words = 2
    while words < 32 and 64 * words < 4.6 * room_of(2 * len(tokens), num, den):
        words *= 2
    return folded(np.frombuffer(sketch_of(tokens, num, den), "<u8")[None], words).tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, with `words` words left."""
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


class Sketches:
    """Sketches of many sets, at every length at which two of them may meet."""

    def __init__(self, blobs: list[bytes]):
        self.words = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
        self.rows: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        above, who = np.zeros((0, 1), np.uint64), np.zeros(0, np.int64)
        for w in sorted(set(self.words.tolist()), reverse=True):
            own = np.flatnonzero(self.words == w)
            above = np.concatenate([folded(above, w) if len(who) else np.zeros((0, w), np.uint64), np.frombuffer(b"".join([blobs[i] for i in own.tolist()]), "<u8").reshape(-1, w)])
            who = np.concatenate([who, own])
            self.rows[w] = above
            self.at[w] = np.full(len(blobs), -1)
            self.at[w][who] = np.arange(len(who))

    def level(self, i: np.ndarray, w: int) -> np.ndarray:
        """Rows of sketches i with w words."""
        if w in self.rows:
            return self.rows[w][self.at[w][i]]
        v = min(x for x in self.rows if x > w)
        return folded(self.rows[v][self.at[v][i]], w)


def slack(x: Sketches, i: np.ndarray, nx: np.ndarray, y: Sketches, j: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """By how many tokens sets i of x and j of y stay within what a linked pair may differ in, by their sizes and sketches; below 0 they can't link."""
    out = room_of(nx + ny, num, den)
    out[(nx * den < ny * num) | (ny * den < nx * num)] = -1
    words = np.minimum(x.words[i], y.words[j])
    for w in np.unique(words[out >= 0]).tolist():
        at = np.flatnonzero((out >= 0) & (words == w))
        step = max(1, 500_000 // w)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            out[part] -= np.bitwise_count(x.level(i[part], w) ^ y.level(j[part], w)).sum(1, dtype=np.int64)
    return out


def prefix_keys(tokens: np.ndarray, counts: np.ndarray, mean: float, frequent: int, num: int, den: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of one set: rare tokens of its extended prefix, and pairs of the frequent ones; the token that leads each key, and how often its nodes are split (functions of the key alone)."""
    n = len(tokens)
    need = -(-n * num // den)
    length = min(n, n - need + (2 if need >= 2 else 1))
    count = counts[tokens >> np.uint64(64 - CELLS)]
    if length < n:
        top = np.partition(count, length - 1)[length - 1]
        few = np.flatnonzero(count <= top)
        order = few[np.lexsort((tokens[few], count[few]))][:length]
    else:
        order = np.arange(n)
    t, c = tokens[order], count[order].astype(np.int64)
    rare = c < frequent
    keys, route, least = t, t, c
    if need >= 2:
        often = np.flatnonzero(~rare)
        often = often[np.argsort(t[often])]
        i, j = (often[x] for x in np.triu_indices(len(often), 1)) if len(often) > 1 else (often[:0], often[:0])
        with np.errstate(over="ignore"):
            keys = np.concatenate([t[rare], mix(t[i] * np.uint64(0x9E3779B97F4A7C15) + t[j] + np.uint64(1))])
        route = np.concatenate([t[rare], t[i]])
        least = np.concatenate([c[rare], np.minimum(c[i], c[j])])
    many = np.maximum(least - 2 * mean, 1) / hot
    return keys, route, (1 << np.ceil(np.log2(np.maximum(many, 1))).astype(np.int64)).astype(np.uint32)


def partnered(group: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: Sketches, num: int, den: int) -> np.ndarray:
    """Which members of groups (in order of group and size) have another member that sizes and sketches (by node) allow."""
    n = len(group)
    out = np.zeros(n, bool)
    for step in range(1, 9):  # neighbours first: they settle small groups, and near copies in large ones
        i = np.arange(n - step)
        i = i[(group[i] == group[i + step]) & ~(out[i] & out[i + step])]
        if not len(i):
            return out
        i = i[slack(sketch, node[i], size[i], sketch, node[i + step], size[i + step], num, den) >= 0]
        out[i] = out[i + step] = True
    begin, end = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
    for i in np.flatnonzero(~out & (end - begin > 9)).tolist():
        a, b = begin[i], end[i]
        j = np.arange(a + np.searchsorted(size[a:b] * den, size[i] * num), a + np.searchsorted(size[a:b] * num, size[i] * den, side="right"))
        j = j[j != i]
        mine = np.full(len(j), i)
        out[i] = (slack(sketch, node[mine], size[mine], sketch, node[j], size[j], num, den) >= 0).any()
    return out


def binaries(names: np.ndarray) -> pa.Array:
    """Fixed 16-byte names as a binary column."""
    return pa.Array.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())


def _described(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Kind -1: a row for each document, with node and sketch. Others: counts by cell of the documents of a task, in pieces."""
    names = ["piece", "doc_id", "n_shingles", "node", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.uint32)
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(*utf8_buffers(batch.column(1)), k)
            cells = (np.concatenate([s for s, _ in sets]) >> np.uint64(64 - CELLS)).astype(np.int64)
            np.add.at(total, cells, 1) if len(cells) < 1 << 16 else np.add(total, np.bincount(cells, minlength=1 << CELLS).astype(np.uint32), out=total)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), batch.column(0).cast(pa.int64()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array([node_of(s) if len(s[0]) else None for s in sets], pa.binary()), pa.array([sketch_of(s, num, den) for s, _ in sets], pa.binary())], names=names)
        if total.any():
            none = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), none, none, pa.nulls(PIECES, pa.binary()), pa.array([pack(x) for x in np.split(total, PIECES)], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "piece int, doc_id long, n_shingles long, node binary, blob binary")


def _counts(described: DataFrame) -> np.ndarray:
    """How many documents hold a token of each cell: pieces of the table are summed side by side, and 2^22 numbers reach the driver."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << CELLS) // PIECES, np.uint64)
        for blob in group.column("blob"):
            total += unpack(blob.as_py(), "<u4")[0]
        return pa.table({"piece": group.column("piece").slice(0, 1), "blob": pa.array([pack(np.minimum(total, 0xFFFFFFFF).astype("<u4"))], pa.binary())})

    rows = described.where("piece >= 0").select("piece", "blob").groupBy("piece").applyInArrow(add, "piece int, blob binary").collect()
    out = np.zeros(1 << CELLS, np.uint32)
    for r in rows:
        size = (1 << CELLS) // PIECES
        out[r["piece"] * size : (r["piece"] + 1) * size] = unpack(bytes(r["blob"]), "<u4")[0]
    return out


def _groups(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int, hot: int) -> DataFrame:
    """(gid, key, nodes, sizes): the nodes under one key, by size; key only where the key is split, and then groups may have one member."""
    buckets, tasks = parts_for(docs, 24 << 20), parts_for(docs, 8 << 20, 12, 200_000)
    mean = float(counts.mean())
    frequent = int(2 * mean + BLOCK)  # the nodes of a rarer token meet in one block
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings (key, split, node, size), packed by bucket; documents of one set once a slice."""
        counts = shipped.value
        for batch in slices(batches, "text", 16 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            seen: dict[bytes, np.ndarray] = {}  # tokens by node
            for part in slices(iter([batch]), "text", 2 << 20):
                for s in shingle_sets(*utf8_buffers(part.column(1)), k):
                    if len(s[0]):
                        seen.setdefault(node_of(s), s[0])
            if not seen:
                continue
            found = [prefix_keys(s, counts, mean, frequent, num, den, hot) for s in seen.values()]
            many = np.fromiter((len(x) for x, _, _ in found), np.int64, len(found))
            key, route, split = (np.concatenate([x[i] for x in found]) for i in range(3))
            names = np.array(list(seen), "S16")
            lead = np.ndarray((len(seen),), "<u8", b"".join(seen), 0, (16,))
            node = np.repeat(np.arange(len(seen)), many)
            sub = (lead[node] % split).astype(np.uint32)  # which part of its key a node is in
            sizes = np.fromiter(map(len, seen.values()), np.int64, len(seen)).astype("<u4")
            small = [small_sketch(s, num, den) for s in seen.values()]
            small_size = np.fromiter(map(len, small), np.int64, len(small)).astype("<u2")
            # keys of one leading token meet in a bucket, where groups much alike become one
            bucket = (mix(route + sub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((node, bucket))
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                s = order[a:b]
                used, local = np.unique(node[s], return_inverse=True)
                out.append((int(bucket[s[0]]), pack(key[s], np.where(split[s] > 1, sub[s] + np.uint32(1), np.uint32(0)).astype("<u4"), local.astype("<u4"), np.frombuffer(names[used].tobytes(), np.uint8), sizes[used], small_size[used], np.frombuffer(b"".join([small[i] for i in used.tolist()]), np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["bucket", "blob"])

    def gather(group: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py(), "<u8", "<u4", "<u4", "u1", "<u4", "<u2", "u1") for b in group.column("blob")]
        key, sub = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        held = np.concatenate([p[3] for p in parts]).view("S16")
        names, at, code = np.unique(held, return_index=True, return_inverse=True)
        size_of = np.concatenate([p[4] for p in parts])[at].astype(np.int64)
        begin = np.cumsum([0] + [len(p[4]) for p in parts])
        node = code[np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, begin.tolist(), strict=False)])]
        order = np.lexsort((node, size_of[node], sub, key))
        key, sub, node = key[order], sub[order], node[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        new = first.copy()
        new[1:] |= node[1:] != node[:-1]
        key, sub, node, first = key[new], sub[new], node[new], first[new]
        length = np.concatenate([p[5] for p in parts]).astype(np.int64)
        ends = np.cumsum(length)
        held_sketches = b"".join([p[6].tobytes() for p in parts])
        small = Sketches([held_sketches[y - n : y] for y, n in zip(ends[at].tolist(), length[at].tolist(), strict=True)])
        keep = partnered(np.cumsum(first), node, size_of[node], small, num, den) | (sub > 0)
        key, sub, node = key[keep], sub[keep], node[keep]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        group = np.cumsum(first) - 1
        # large groups with one least node are united: near copies share many keys, and a pair needs to meet once
        if len(group):
            begin = np.flatnonzero(first)
            united = (np.diff(np.append(begin, len(group))) >= UNITE) & (sub[begin] == 0)
            group = np.where(united, len(begin) + np.minimum.reduceat(node, begin), np.arange(len(begin)))[group]
            order = np.lexsort((node, size_of[node], group))
            key, sub, node, group = key[order], sub[order], node[order], group[order]
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
            key, sub, node, group = key[new], sub[new], node[new], group[new]
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(key))
        keep = (np.diff(edges) > 1) | (sub[edges[:-1]] > 0)
        seen: dict[tuple, tuple] = {}
        for a, b in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), strict=True):
            gid = hashlib.blake2b(names[node[a:b]].tobytes(), digest_size=16).digest()
            seen.setdefault((gid, int(key[a].astype(np.int64)) if sub[a] else None), (a, b))
        spans = list(seen.values())
        flat = np.concatenate([node[a:b] for a, b in spans]) if spans else node[:0]
        ends = np.cumsum([0] + [b - a for a, b in spans]).astype(np.int32)
        return pa.table({"gid": pa.array([g for g, _ in seen], pa.binary()), "key": pa.array([x for _, x in seen], pa.int64()), "nodes": pa.ListArray.from_arrays(ends, binaries(names[flat])), "sizes": pa.ListArray.from_arrays(ends, pa.array(size_of[flat], pa.int64()))})

    pieces = docs.select("doc_id", "text").mapInArrow(index, "bucket int, blob binary").repartition(tasks, "bucket")
    return pieces.groupBy("bucket").applyInArrow(gather, "gid binary, key long, nodes array<binary>, sizes array<long>")


def _bit(doc_id: np.ndarray) -> np.ndarray:
    return (mix(doc_id.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ASKED)).astype(np.int64)


def _texts_of(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(node, packed text) of the nodes in asked (doc_id, node). A bitmap of the ids keeps most other texts out of the shuffle; the join on doc_id is exact."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << ASKED - 3, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([pack(x) for x in np.split(bits, PIECES)], pa.binary())], names=["piece", "blob"])

    def either(group: pa.Table) -> pa.Table:
        bits = np.zeros((1 << ASKED - 3) // PIECES, np.uint8)
        for blob in group.column("blob"):
            bits |= unpack(blob.as_py(), "u1")[0]
        return pa.table({"piece": group.column("piece").slice(0, 1), "blob": pa.array([pack(bits)], pa.binary())})

    pieces = asked.select("doc_id").mapInArrow(mark, "piece int, blob binary").groupBy("piece").applyInArrow(either, "piece int, blob binary").collect()  # 16 rows, 8 MB in all
    bits = np.concatenate([unpack(bytes(r["blob"]), "u1")[0] for r in sorted(pieces, key=lambda r: r["piece"])]) if pieces else np.zeros(1 << ASKED - 3, np.uint8)
    shipped = docs.sparkSession.sparkContext.broadcast(pack(bits))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(shipped.value, "u1")[0]
        squeeze = zstandard.ZstdCompressor(level=5).compress
        for batch in slices(batches, "text", 4 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            at = _bit(batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            if batch.num_rows:
                raw, off = utf8_buffers(batch.column(1))
                data = [squeeze(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "packed"])

    def of_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows of one doc_id may hold different texts
            texts = [zstandard.decompress(t) for t in batch.column(1).to_pylist()]
            off = np.cumsum([0] + [len(t) for t in texts])
            sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), off, k)
            yield batch.select([0, 1]).filter(pa.array([node_of(s) == n for s, n in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    chosen = docs.select("doc_id", "text").mapInArrow(choose, "doc_id long, packed binary")
    return chosen.join(asked, "doc_id").select("node", "packed").mapInArrow(of_node, "node binary, packed binary").dropDuplicates(["node"])


def _components(docs: DataFrame, k: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    described = _described(docs, k, num, den).checkpoint()
    rows = described.where("piece < 0").select("doc_id", "n_shingles", "node", F.col("blob").alias("sketch"))
    known = rows.where("node is not null and doc_id is not null")
    least = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    found = _groups(docs, _counts(described), k, num, den, hot).checkpoint()
    groups = found.select("gid", "nodes", "sizes").dropDuplicates(["gid"]).checkpoint()
    # families: the parts of a split key, equal families once
    parts = found.where("key is not null").groupBy("key").agg(F.sort_array(F.collect_set("gid")).alias("gids")).where(F.size("gids") > 1)
    parts = parts.select("gids", F.unhex(F.sha2(F.array_join(F.transform("gids", F.hex), ""), 256)).alias("root")).dropDuplicates(["root"]).select("root", F.explode("gids").alias("gid")).checkpoint()
    split = not parts.isEmpty()
    member = F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("sizes").alias("size"))).alias("x")
    flat = groups.where(F.size("nodes") > 1).select(F.col("gid").alias("root"), F.size("nodes").cast("long").alias("members"), member)
    if split:
        wide = parts.join(groups, "gid")
        total = wide.groupBy("root").agg(F.sum(F.size("nodes")).cast("long").alias("members"))
        flat = flat.unionByName(wide.join(total, "root").select("root", "members", member))
    flat = flat.select("root", "members", "x.node", "x.size")
    sketches = known.select("node", "sketch").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets link, compared by their words."""
        asked = least.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select(F.col("least").alias("doc_id"), "node")
        texts = _texts_of(docs, asked.checkpoint(), k).checkpoint()

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, of_u = None, set()
            for batch in batches:
                ok = []
                for u, _, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if u != last:
                        last, of_u = u, shingle_words(zstandard.decompress(x), k)
                    of_v = shingle_words(zstandard.decompress(y), k)
                    same = len(of_u & of_v)
                    ok.append(den * same >= num * (len(of_u) + len(of_v) - same))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        both = pairs.join(texts.select(F.col("node").alias("v"), F.col("packed").alias("y")), "v").join(texts.select(F.col("node").alias("u"), F.col("packed").alias("x")), "u")
        return both.select("u", "v", "x", "y").mapInArrow(check, "u binary, v binary").checkpoint()

    def across(limit: int | None) -> Callable[[pa.Table], pa.Table]:
        """Pairs of members of different components that sizes and sketches don't rule out. Where they are more than `limit` a member, only the pairs of each member with its nearest and of the one with most, and the group's root to come back to."""

        def run(group: pa.Table) -> pa.Table:
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            block, size = (group.column(c).to_numpy().astype(np.int64) for c in ("own", "size"))
            label = np.unique(np.array(group.column("label").to_pylist(), "S16"), return_inverse=True)[1]
            names = np.array(group.column("node").to_pylist(), "S16")
            sketch = Sketches(group.column("sketch").to_pylist())
            order = np.lexsort((names, size))
            left, right = order[block[order] == i], order[block[order] == j]
            low = np.searchsorted(size[right] * den, size[left] * num, side="left")
            high = np.searchsorted(size[right] * num, size[left] * den, side="right")
            us, vs, many = [left[:0]], [left[:0]], 0
            most, with_, partners = np.full(len(size), -1), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)

            def met(k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                other = other[label[other] != label[k]]
                mine = np.full(len(other), k)
                left_over = slack(sketch, mine, size[mine], sketch, other, size[other], num, den) if len(other) else other
                hit = left_over >= 0
                return mine[hit], other[hit], left_over[hit]

            few = True
            for n, (k, a, b) in enumerate(zip(left.tolist(), low.tolist(), high.tolist(), strict=True)):
                mine, other, left_over = met(k, right[max(a, n + 1) : b] if i == j else right[a:b])  # within a block each pair once
                if not len(other):
                    continue
                many += len(other)
                few = few and (limit is None or many <= limit * len(size))
                if few:
                    us.append(mine)
                    vs.append(other)
                if limit is not None:
                    partners[k] += len(other)
                    partners[other] += 1
                    best = int(left_over.argmax())
                    if left_over[best] > most[k]:
                        most[k], with_[k] = left_over[best], other[best]
                    more = left_over > most[other]
                    most[other[more]], with_[other[more]] = left_over[more], k
            if not few:
                near = np.flatnonzero(most >= 0)
                centre = int(partners.argmax())
                mine, other, _ = met(centre, order if i == j else right if block[centre] == i else left)
                us, vs = [near, mine], [with_[near], other]
            u, v = np.concatenate(us), np.concatenate(vs)
            back = 0 if few else 1
            fill = pa.nulls(back, pa.binary())
            return pa.table({"u": pa.concat_arrays([binaries(names[u]), fill]), "v": pa.concat_arrays([binaries(names[v]), fill]), "root": pa.concat_arrays([pa.nulls(len(u), pa.binary()), group.column("root").slice(0, back).combine_chunks().cast(pa.binary()) if back else fill])})

        return run

    # rounds: all groups, then those with too many pairs to give out, as long as they hold several components
    labels = tested = held = None
    limit: int | None = LIMIT
    while True:
        if labels is None:
            now = flat.join(sketches, "node").withColumn("label", F.col("node"))
        else:
            now = held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = now.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root")
            now = now.join(mixed, "root", "left_semi")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        met = now.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        met = met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "sketch", "label")
        out = met.groupBy("root", "i", "j").applyInArrow(across(limit), "u binary, v binary, root binary").checkpoint()
        pairs = out.where("root is null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = (pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")).checkpoint()
        links = pairs if pairs.isEmpty() else verify(pairs)
        merged = not links.isEmpty()
        if labels is None:
            labels, tested = connected_components(links).checkpoint(), pairs
        else:
            tested = tested.unionByName(pairs)
            if merged:
                labels = connected_components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links)).checkpoint()
        dense = out.where("root is not null").select("root").distinct()
        if dense.isEmpty():
            break
        if held is None:
            held = flat.join(dense, "root", "left_semi").join(sketches, "node").checkpoint()
        limit = LIMIT if merged else None
    linked = least.join(labels, "node")
    linked = linked.join(linked.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    of_node = least.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    some = known.join(of_node, "node").select("doc_id", "n_shingles", "node", "component_id")
    return some.unionByName(rows.where("node is null or doc_id is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))


def link_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _components(docs, k, num, den, hot).select("doc_id", "n_shingles", "component_id")


def _with_node(docs: DataFrame, k: int, name: str) -> DataFrame:
    """docs and the name of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(*utf8_buffers(batch.column(batch.schema.get_field_index("text"))), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(s) if len(s[0]) else None for s in sets], pa.binary())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{name}` binary")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents with one row of each component: of the rows whose doc_id is the component's, one for each different set. Rows without doc_id or words stay."""
    name, rank = "kept_node", "kept_rank"
    while name in docs.columns or rank in docs.columns:
        name, rank = name + "_", rank + "_"
    kept = _components(docs, k, num, den).where("component_id = doc_id and node is not null").select("doc_id", F.col("node").alias(name)).distinct()
    named = _with_node(docs, k, name)
    alone: Column = F.col("doc_id").isNull() | F.col(name).isNull()
    some = named.where(~alone).join(kept, ["doc_id", name], "left_semi")
    some = some.withColumn(rank, F.row_number().over(W.partitionBy("doc_id", name).orderBy("text"))).where(F.col(rank) == 1)
    return some.select(docs.columns).unionByName(named.where(alone).select(docs.columns))
