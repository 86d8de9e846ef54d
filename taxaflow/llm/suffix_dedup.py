"""Suffix-array dedup: every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

Segments (see windows.py) of a bucket are suffix-sorted by deep-shallow sorting. Shallow, in place of multikey
quicksort: a vectorised sort (np.lexsort) of all open groups at once by eight-byte words, down to `shallow` bytes; no pivot
and no three-way partition, and the same order. Deep (groups of two are compared outright): each group that still agrees there is
ordered by a blind trie, a Patricia tree that stores only branching positions and compares a string once, with the leaf
its branching bytes lead to. Sorting first orders whole segments (equal neighbours are copies), then the window suffixes
of distinct segments whose context around the minimizer recurs; the first suffix of a run of equal ones with the
smallest document decides the others.

Null text is empty. A null doc_id is not smaller than any other and nothing is smaller than it: such rows stay whole.
Rows with one doc_id don't remove each other's bytes. Texts under 50 bytes stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxaflow.llm.common import byte_values, document_chunks, mix, ragged, range_hashes
from taxaflow.llm.windows import Bucket, emit, remove_repeats, segments, spans_out

LENGTH, K = 50, 8
_MASK = np.array([0] + [(1 << 64) - (1 << 8 * (8 - k)) for k in range(1, 9)], np.uint64)


class BlindTrie:
    """Sorts strings that share a long prefix. Equal strings share a leaf."""

    __slots__ = ("leaves", "root", "strings")

    def __init__(self) -> None:
        self.root = None  # a leaf number, or [depth, {byte or -1 at the end: child}]
        self.strings: list[bytes] = []
        self.leaves: list[list[int]] = []

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = self._leaf(s, item)
            return
        path, node = [], self.root
        while not isinstance(node, int):
            path.append(node)
            depth, kids = node
            c = s[depth] if depth < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        t = self.strings[node]
        if s == t:
            self.leaves[node].append(item)
            return
        low, high = 0, min(len(s), len(t))
        while low < high:  # length of the common prefix
            mid = (low + high + 1) // 2
            if s[:mid] == t[:mid]:
                low = mid
            else:
                high = mid - 1
        c, d = (x[low] if low < len(x) else -1 for x in (s, t))
        new = self._leaf(s, item)
        above = None
        for p in path:
            if p[0] >= low:
                break
            above = p
        if above is not None:
            mine = s[above[0]] if above[0] < len(s) else -1
            below = above[1][mine]
        else:
            below = self.root
        if not isinstance(below, int) and below[0] == low:
            below[1][c] = new
            return
        node = [low, {d: below, c: new}]
        if above is None:
            self.root = node
        else:
            above[1][mine] = node

    def _leaf(self, s: bytes, item: int) -> int:
        self.strings.append(s)
        self.leaves.append([item])
        return len(self.leaves) - 1

    def runs(self) -> Iterator[list[int]]:
        """Items of equal strings together, in string order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                yield self.leaves[node]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow_sort(raw: np.ndarray, at: np.ndarray, size: np.ndarray, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): strings raw[at : at + size] in order; new[i]: order[i] differs from the string before it."""
    n = len(at)
    order = np.arange(n)
    new = np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    padded = np.concatenate([raw, np.zeros(shallow + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), 0, (1,))
    open_ = np.arange(n)  # places in `order` whose group still has more than one string
    for depth in range(0, shallow, 8):
        s = order[open_]
        left = np.clip(size[s] - depth, 0, 8)
        word = words[np.minimum(at[s] + depth, len(raw))].astype(np.uint64) & _MASK[left]
        group = np.cumsum(new[open_])
        by = np.lexsort((left, word, group))  # a string that ends sorts before its continuations
        word, left = word[by], left[by]
        order[open_] = s[by]
        split = np.ones(len(open_), bool)
        split[1:] = (word[1:] != word[:-1]) | (left[1:] != left[:-1])
        new[open_] |= split
        ends = np.append(new[open_[1:]], True)
        open_ = open_[~(new[open_] & ends)]
        if not len(open_):
            return order, new
        # places of one group are neighbours, so `open_` stays in order
    # deep: groups that agree on `shallow` bytes
    data = raw.tobytes()
    heads = np.flatnonzero(new[open_])
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(open_)).tolist(), strict=True):
        places = open_[a:b]
        items = order[places].tolist()
        texts = [data[at[i] + shallow : at[i] + size[i]] if size[i] > shallow else b"" for i in items]
        if len(items) == 2:
            x, y = texts
            if x > y:
                items.reverse()
            order[places] = items
            new[places[1]] = x != y
            continue
        trie = BlindTrie()
        insert = trie.insert
        for s, i in zip(texts, items, strict=True):
            insert(s, i)
        k = int(places[0])
        for run in trie.runs():
            order[k : k + len(run)] = run
            new[k : k + len(run)] = False
            new[k] = True
            k += len(run)
    return order, new


def cut(raw: np.ndarray, off: np.ndarray, ids: np.ndarray, sums: np.ndarray, buckets: int, groups: int) -> Iterator[tuple[int, bytes]]:
    if len(raw) < LENGTH:
        return
    padded = np.concatenate([raw, np.zeros(16, np.uint8)]).tobytes()
    found = []
    for a, b in document_chunks(off, 1 << 16):  # some 20 numbers a byte: a few documents at a time
        low, high = int(off[a]), int(off[b])
        first, n, doc, least, code = segments(np.ndarray((high - low,), "<u8", padded, low, (1,)), off[a : b + 1] - low, LENGTH, K)
        if len(first):
            same = range_hashes(byte_values(raw[low:high]), first, first + n + LENGTH - 1)
            found.append((first + low, n, doc + a, least + low, code, same))
    if found:
        first, n, doc, least, code, same = (np.concatenate(x) for x in zip(*found, strict=True))
        yield from emit(first, n, doc, least, code, off, same, ids, sums, first, n + LENGTH - 1, raw, buckets, groups, LENGTH, level=9)


def decide(bucket: Bucket, groups: int) -> pa.Table:
    items = np.arange(len(bucket.doc))
    raw = bucket.content
    at, size, doc = bucket.at[items], bucket.size[items], bucket.doc[items]
    # whole segments: copies are neighbours
    order, new = deep_shallow_sort(raw, at, size)
    text = np.empty(len(items), np.int64)
    text[order] = np.cumsum(new) - 1
    n_texts = int(new.sum())
    least = np.full(n_texts, np.iinfo(np.int64).max)
    np.minimum.at(least, text, doc)
    copies = doc > least[text]
    # distinct segments: windows whose context recurs around the minimizer. One with o >= 21 bytes left of it holds
    # [m - 21, m + 8), any other [m, m + 29)
    rep = np.empty(n_texts, np.int64)
    rep[text] = np.arange(len(items))
    t_at, t_size, t_n, m = at[rep], size[rep], bucket.n[items][rep], bucket.offset[items][rep]
    padded = np.concatenate([raw, np.zeros(40, np.uint8)]).tobytes()
    words = np.ndarray((len(raw) + 33,), "<u8", padded, 0, (1,))

    def recurs(have: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(n_texts, bool)
        who = np.flatnonzero(have)
        with np.errstate(over="ignore"):
            key = np.zeros(len(who), np.uint64)
            for s in steps:
                key = mix(key * np.uint64(31) + words[t_at[who] + m[who] + s])
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        out[who] = count[inv] > 1
        return out

    side_a = recurs(m >= 21, (-21, -13, -5, 0))
    side_b = recurs(m + 29 <= t_size, (0, 8, 16, 21))
    # window start s has o = m - s bytes left of the minimizer
    low = np.where(side_a, 0, np.maximum(m - 20, 0))
    high = np.where(side_b, t_n, np.minimum(np.maximum(m - 20, 0), t_n))
    count = np.where(side_a | side_b, np.maximum(high - low, 0), 0)
    owner = np.repeat(np.arange(n_texts), count)
    start = ragged(low, count)
    order, new = deep_shallow_sort(raw, t_at[owner] + start, np.full(len(owner), LENGTH))
    run = np.cumsum(new) - 1
    smallest = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(smallest, run, least[owner[order]])
    hit = order[smallest[run] < least[owner[order]]]
    h_owner, h_start = owner[hit], start[hit]
    # every item that holds the text in its smallest document gets the text's hits; other copies lose all windows
    by = np.lexsort((h_start, h_owner))
    h_owner, h_start = h_owner[by], h_start[by]
    begin, end = np.searchsorted(h_owner, np.arange(n_texts)), np.searchsorted(h_owner, np.arange(n_texts), side="right")
    mine = np.flatnonzero(~copies)
    many = (end - begin)[text[mine]]
    part_item = np.repeat(items[mine], many)
    part_start = h_start[ragged(begin[text[mine]], many)]
    all_items = np.flatnonzero(copies)
    item = np.concatenate([items[all_items], part_item])
    return spans_out(bucket, item, np.concatenate([np.zeros(len(all_items), np.int64), part_start]), np.concatenate([bucket.n[items[all_items]], np.ones(len(part_item), np.int64)]), LENGTH, groups)


RESULT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return text
    edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame) -> DataFrame:
    def finish(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        return len(text), int((b - a).sum()), len(a), hashlib.sha256(_kept(text, a, b)).hexdigest()

    return remove_repeats(docs, cut, decide, finish, RESULT)


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """documents with the repeated bytes taken out. A character cut in the middle is dropped; n_chars is counted anew. Whole documents stay, even if empty."""

    def finish(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        out = _kept(text, a, b).decode("utf-8", "ignore")
        return out, len(out)

    return remove_repeats(docs, cut, decide, finish, pa.schema([("text", pa.string()), ("n_chars", pa.int64())]), keep)
