"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Code points map to a few classes; each class is a transition
function of a small automaton, and functions compose. The composition is associative, so a blocked scan finds the state
before every code point: blocks are composed independently (vectorised over blocks), a short scan links the blocks, and a
second vectorised sweep marks the boundaries. Slices between boundaries go through a cache; all slices missing from the
cache are merged together, pair by pair, in numpy. A slice's ids are cached with it and its offsets are kept.

Null text encodes as empty text. Each row is encoded alone, so repeated rows give equal results; slices are shared only if
their bytes are equal. Of two pairs of equal rank the left one merges first. An empty table gives no rows. Columns other
than doc_id and text are not looked at by digests(); encode_column() replaces columns named ids and slice_starts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxaflow.llm.common import distinct_codes, ragged, short_codes, slices

# Code points with the property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

L, N, O, AP, SP, WL, W, K1, K2 = range(9)  # classes: letter, number, other, apostrophe, last blank before a word, last other space, inner space, contraction letter, first of two contraction letters
BREAK, S_L, S_N, S_O, S_SP, S_W, S_AP, S_C2 = range(8)  # states: before any boundary, inside L N O, after a lone blank, inside spaces, after a leading apostrophe, inside a two-letter contraction


def _step(state: int, c: int) -> tuple[int, bool]:
    """(next state, whether a slice starts at this code point)."""
    if state == S_AP and c in (K1, K2):
        return (BREAK, False) if c == K1 else (S_C2, False)
    if state == S_C2:
        return BREAK, False
    kind = {L: S_L, K1: S_L, K2: S_L, N: S_N, O: S_O, AP: S_O}.get(c)
    if kind is not None:
        if state == S_SP or state == kind or (state == S_AP and kind == S_O):
            return kind, False
        return (S_AP if c == AP else kind), True
    if c == W:
        return S_W, state != S_W
    return (S_SP if c == SP else BREAK), True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(compose[f, g] = g after f, value[f, state], function of each class, starts[state, class]), closed under composition."""
    base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    base += [(f[BREAK],) * 8 for f in base]  # the first code point of a text: what came before doesn't matter
    found = {tuple(range(8)): 0}
    for f in base:
        found.setdefault(f, len(found))
    queue = list(found)
    while queue:
        f = queue.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    names = list(found)
    table = np.zeros((len(names), 18), np.int64)
    for f in names:
        for j, g in enumerate(base):
            table[found[f], j] = found[tuple(g[x] for x in f)]
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return table, np.array(names), np.array([found[f] for f in base]), starts


@lru_cache(1)
def _classes() -> np.ndarray:
    import sys
    import unicodedata

    first = {"L": L, "N": N}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = W
    table[39] = AP
    return table


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where slices start in texts laid end to end. points: their code points; ends: where each text ends."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    c = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    space = np.append(c == W, False)
    last = space[:-1] & ~space[1:] & ~first[1:]  # followed by a word of the same text
    c[last & (points == 32)] = SP
    c[last & (points != 32)] = WL
    # contraction letters; "re" "ve" "ll" need their second letter, which the classes look ahead for
    q = np.flatnonzero(points == 39) + 1
    q = q[(q < n) & ~first[np.minimum(q, n)]]
    if len(q):
        c[q[np.isin(points[q], [115, 116, 109, 100])]] = K1
        r = q[q + 1 < n]
        r = r[~first[r + 1]]
        x, y = points[r], points[r + 1]
        c[r[((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)]] = K2
    step, value, _, starts = _monoid()
    f = c.astype(np.int16)
    f[first[:-1]] += 9
    # blocks of `width` code points, one a column
    width = 256
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.int16)
    padded[:n] = f
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat = step.ravel()
    acc = np.zeros(rows, np.int64)
    for row in grid:
        acc = flat[acc * 18 + row]
    state = np.empty(rows, np.int64)  # before each block
    s = BREAK
    for i, g in enumerate(acc.tolist()):
        state[i] = s
        s = value[g, s]
    nxt = np.array([[_step(s, x)[0] for x in range(9)] + [_step(BREAK, x)[0] for x in range(9)] for s in range(8)]).ravel()
    mark = np.concatenate([starts, np.ones_like(starts)], axis=1).ravel()
    out = np.empty(grid.shape, bool)
    for j, row in enumerate(grid):
        at = state * 18 + row
        out[j] = mark[at]
        state = nxt[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


class Bpe:
    """Ranks of a vocabulary, with a bounded cache of encoded slices."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 400_000):
        self.ranks, self.cached = ranks, cached
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self._index(pairs)
        self.pairs = pairs
        self.cache: dict[bytes, bytes] = {}

    def _index(self, pairs: dict[int, int]) -> None:
        """An open-addressing table in numpy: every pair within `probes` slots of its home."""
        bits = max(10, int(np.ceil(np.log2(max(1, len(pairs)) * 8))))
        self.shift = np.uint64(64 - bits)
        keys, vals = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
        todo_k = np.fromiter(pairs.keys(), np.int64, len(pairs))
        todo_v = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.probes = 0
        while len(todo_k):
            at = self._home(todo_k) + self.probes
            free = keys[at] < 0
            _, pick = np.unique(np.where(free, at, -1), return_index=True)
            pick = pick[free[pick]]
            keys[at[pick]], vals[at[pick]] = todo_k[pick], todo_v[pick]
            left = np.ones(len(todo_k), bool)
            left[pick] = False
            todo_k, todo_v, self.probes = todo_k[left], todo_v[left], self.probes + 1
        self.keys, self.vals = keys, vals

    def _home(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    NONE = (1 << 31) - 1

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 20 | b
        at = self._home(k)
        held = self.keys[at]
        out = np.where(held == k, self.vals[at], self.NONE)
        open_ = np.flatnonzero((held != k) & (held >= 0) & (k >= 0))
        k, at = k[open_], at[open_]
        while len(open_):  # most pairs stand at their home slot
            at += 1
            held = self.keys[at]
            hit = held == k
            out[open_[hit]] = self.vals[at[hit]]
            more = ~hit & (held >= 0)
            open_, k, at = open_[more], k[more], at[more]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each slice, as little-endian unsigned 32-bit integers. Slices of like length are merged side by side."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = int(lengths[order[at]])
            if size > 64:
                for i in order[at:].tolist():
                    out[i] = np.array(self._merge_long(pieces[i]), "<u4").tobytes()
                break
            to = int(np.searchsorted(lengths[order], size, side="right"))
            to = min(to, at + 20_000)
            group = order[at:to]
            ids = self.single[np.frombuffer(b"".join([pieces[i] for i in group.tolist()]), np.uint8)].reshape(len(group), size)
            for i, row in zip(group.tolist(), self._merge_rows(ids), strict=True):
                out[i] = row
            at = to
        return out

    def _merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """Slices of one length, a row each. All rows merge their lowest pair in each round; finished rows leave."""
        count, size = ids.shape
        out: list[bytes] = [b""] * count
        live, length = np.arange(count), size
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1) if size > 1 else np.empty((count, 0), np.int32)
        while len(live):
            # after r rounds every live row has size - r symbols
            if length > 1:
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(live)), best]
                done = rank == self.NONE
            else:
                done = np.ones(len(live), bool)
            if done.any():
                step, data = 4 * length, ids[done].astype("<u4").tobytes()
                for j, i in enumerate(live[done].tolist()):
                    out[i] = data[j * step : (j + 1) * step]
                live, ids, ranks = live[~done], ids[~done], ranks[~done]
                if not len(live):
                    break
                best, rank = best[~done], rank[~done]
            rows = np.arange(len(live))
            keep = np.ones(ids.shape, bool)
            keep[rows, best + 1] = False
            ids = ids[keep].reshape(len(live), length - 1)
            ids[rows, best] = rank
            keep = np.ones(ranks.shape, bool)
            keep[rows, best] = False
            ranks = ranks[keep].reshape(len(live), length - 2)
            length -= 1
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < length - 1)
            x, y = best[left], best[right]
            got = self.rank(np.concatenate([ids[left, x - 1], ids[right, y]]), np.concatenate([ids[left, x], ids[right, y + 1]]))
            ranks[left, x - 1], ranks[right, y] = got[: len(left)], got[len(left) :]
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """A heap over linked symbols: n log n for one long slice."""
        import heapq

        n = len(piece)
        ids = [int(self.single[b]) for b in piece]
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
            for x, y in ((prev[i], i), (i, k)):
                if x >= 0 and y >= 0 and (q := pairs.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """(ids as little-endian u32, slice starts in code points) of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = np.flatnonzero(boundaries(points, ends))
        width = np.ones(len(points), np.int8) if whole.isascii() else 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        edges = at[np.append(start, len(points))]
        raw = whole.encode()
        pick, which = self._distinct(raw, edges)
        pieces = [raw[a:b] for a, b in zip(edges[pick].tolist(), edges[pick + 1].tolist(), strict=True)]
        cache = self.cache
        coded = list(map(cache.get, pieces))
        gaps = [i for i, x in enumerate(coded) if x is None]
        if gaps:
            found = self._encode_pieces([pieces[i] for i in gaps])
            for i in gaps:
                coded[i] = found[pieces[i]]
            if len(cache) + len(found) > self.cached:
                cache.clear()
            cache.update(found)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        ids = flat[ragged((np.cumsum(size) - size)[which], size[which])]
        token = np.zeros(len(start) + 1, np.int64)
        np.cumsum(size[which], out=token[1:])
        cut = np.append(np.searchsorted(start, ends - sizes), len(start)).tolist()
        begin = (ends - sizes).tolist()
        return [(ids[token[cut[i]] : token[cut[i + 1]]].tobytes(), start[cut[i] : cut[i + 1]] - begin[i]) for i in range(len(texts))]

    @staticmethod
    def _distinct(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one place of each distinct slice, which of them each slice is). Slices are compared by their bytes: up to 15 as numbers, longer ones in a dictionary."""
        at, size = edges[:-1], np.diff(edges)
        low, high = short_codes(raw, at, size)
        long = np.flatnonzero(size > 15)
        if len(long):
            seen: dict[bytes, int] = {}
            low[long] = [seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(at[long].tolist(), size[long].tolist(), strict=True)]
            high[long] = np.uint64(1 << 63)
        return distinct_codes(low, high)

    def _encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        found, apart = {}, []
        for p in pieces:
            if (r := self.ranks.get(p)) is not None:
                found[p] = r.to_bytes(4, "little")
            else:
                apart.append(p)
        found.update(zip(apart, self.merge(apart), strict=True))
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))




#: Bytes of text that are encoded at once; a worker takes some 90 bytes for each.
SLICE = 1 << 19
_BY_TEXT: dict[int, Bpe] = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, to ship to the executors (a vocabulary is a fixed 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def bpe_of(data: bytes) -> Bpe:
    """One Bpe for each vocabulary and Python worker."""
    key = hash(data)
    if key not in _BY_TEXT:
        _BY_TEXT.clear()
        _BY_TEXT[key] = Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})
    return _BY_TEXT[key]


def encode_column(docs: DataFrame, ranks: bytes, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs plus `ids` (binary, little-endian u32), and `slice_starts` where offsets are asked for. One narrow pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in docs.columns if c not in ("ids", "slice_starts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(shipped.value)
        for batch in slices(batches, text, SLICE):
            got = bpe.encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            more = [pa.array([g[0] for g in got], pa.binary())]
            if offsets:
                more.append(pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "ids", "slice_starts"][: len(names) + len(more)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.select(names).mapInArrow(run, f"{kinds}, ids binary" + ", slice_starts array<int>" * offsets)


def digests(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_slices of every document: encoded, then decoded from the ids alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(shipped.value)
        for batch in slices(batches, "text", SLICE):
            rows = []
            for coded, starts in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(coded, "<u4")
                back = bpe.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(back).hexdigest(), len(starts)))
            n, a, b, m = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(m, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_slices"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long")
