"""Substring dedup with repeated-phrase automata: every word covered by a 13-word window that also starts in a document with a smaller doc_id.

Words are maximal runs of bytes outside \\x20 and \\x09-\\x0D, unchanged. Segments (see windows.py) meet by bucket. There
recurring passages are confirmed by comparing their words: whole segments found in several documents, and single windows
found in several distinct segments. They are compiled into an Aho-Corasick automaton (one shard of the set of passages)
that carries the smallest doc_id of each passage, and every document's segments of the bucket stream through it to
locate every occurrence.

Null text has no words. Rows without doc_id stay whole; rows with one doc_id don't remove each other's words; documents of
fewer than 13 words stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxaflow.llm.common import byte_codes, code_hashes, document_chunks, ragged, range_hashes, same_bytes, word_bounds
from taxaflow.llm.windows import Bucket, emit, remove_repeats, segments, spans_out

LENGTH, K = 13, 3
LETTERS = 2 << 20  # of the passages in one automaton, which takes some 40 bytes for each


def normal(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words each followed by one blank, where each starts and the end, each document's first word and the end)."""
    start, end, doc = word_bounds(raw, off)
    size = end - start + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    flat = np.append(raw, np.uint8(32))[np.minimum(ragged(start, size), len(raw))]
    flat[at[1:] - 1] = 32
    return flat, at, np.searchsorted(doc, np.arange(len(off)))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(words), np.uint64)
        for i in range(k):
            out[: len(words) - i] = out[: len(words) - i] * np.uint64(0x9E3779B97F4A7C15) + words[i:]
    return out


def cut(raw: np.ndarray, off: np.ndarray, ids: np.ndarray, sums: np.ndarray, buckets: int, groups: int) -> Iterator[tuple[int, bytes]]:
    found, flats, firsts, used, words_before = [], [], [np.zeros(1, np.int64)], 0, 0
    for a, b in document_chunks(off, 1 << 19):  # many numbers a byte: a few documents at a time
        flat, at, bounds = normal(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        words = code_hashes(*byte_codes(flat, at[:-1], np.diff(at) - 1))
        first, n, doc, least, code = segments(_grams(words, K), bounds, LENGTH, K)
        if len(first):
            begin, end = at[first], at[first + n + LENGTH - 1]
            found.append((first + words_before, n, doc + a, least + words_before, code, range_hashes(words, first, first + n + LENGTH - 1), begin + used, end - begin))
        flats.append(flat)
        firsts.append(bounds[1:] + words_before)
        used, words_before = used + len(flat), words_before + len(words)
    if found:
        first, n, doc, least, code, same, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
        yield from emit(first, n, doc, least, code, np.concatenate(firsts), same, ids, sums, begin, size, np.concatenate(flats), buckets, groups, LENGTH)


def _found(passages: list[bytes], first: int, stream: str) -> np.ndarray:
    """(end, number of the passage) of every occurrence."""
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(passages, first):
        automaton.add_word(" " + p.decode("latin-1"), i)
    automaton.make_automaton()
    return np.fromiter(chain.from_iterable(automaton.iter(stream)), np.int64).reshape(-1, 2)


def decide(bucket: Bucket, groups: int) -> pa.Table:
    items = np.arange(len(bucket.doc))
    raw = bucket.content.tobytes()
    at, size, doc, n = bucket.at[items], bucket.size[items], bucket.doc[items], bucket.n[items]
    begin = at.tolist()
    # distinct segments, compared by their bytes
    seen: dict[bytes, int] = {}
    text = np.fromiter((seen.setdefault(raw[a : a + s], len(seen)) for a, s in zip(begin, size.tolist(), strict=True)), np.int64, len(items))
    texts = list(seen)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    most = np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(least, text, doc)
    np.maximum.at(most, text, doc)
    rep = np.empty(len(texts), np.int64)
    rep[text] = np.arange(len(items))
    # word starts of each distinct segment
    ends = np.flatnonzero(bucket.content == 32) + 1
    word0 = np.searchsorted(ends, at[rep], side="right")
    begins = np.concatenate([[0], ends])
    t_n = n[rep]
    # windows that recur in another distinct segment: found by hash, confirmed by their words
    words = code_hashes(*byte_codes(bucket.content, begins[:-1], np.diff(begins) - 1))
    owner = np.repeat(np.arange(len(texts)), t_n)
    start = ragged(np.zeros(len(texts), np.int64), t_n)
    w = word0[owner] + start
    keys = range_hashes(words, w, w + LENGTH)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twice = np.zeros(len(k), bool)
    if len(k):
        eq = k[1:] == k[:-1]
        twice[1:] |= eq
        twice[:-1] |= eq
    again = order[twice]
    new = np.ones(len(again), bool)
    new[1:] = keys[again[1:]] != keys[again[:-1]]
    a, b = begins[w[again]], begins[w[again] + LENGTH]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    equal = (b - a == (b - a)[head]) & same_bytes(bucket.content, a, np.minimum(a[head], len(bucket.content) - (b - a)), b - a)
    if not equal.all():  # windows of one hash: told apart by their bytes
        apart: dict[tuple, int] = {}
        code = np.fromiter((apart.setdefault((h, raw[x:y]), len(apart)) for h, x, y in zip(head.tolist(), a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
        by = np.argsort(code, kind="stable")
        again, a, b, code = again[by], a[by], b[by], code[by]
        new = np.append(True, code[1:] != code[:-1])
    at_new = np.flatnonzero(new)
    low = np.minimum.reduceat(least[owner[again]], at_new) if len(at_new) else least[:0]
    high = np.maximum.reduceat(most[owner[again]], at_new) if len(at_new) else least[:0]
    # passages of the automaton: length in bytes, words, smallest document
    spread = high > low
    single = at_new[spread]
    whole = np.flatnonzero(most > least)
    passages = [raw[x:y] for x, y in zip(a[single].tolist(), b[single].tolist(), strict=True)]
    known = set(passages)
    whole = np.array([i for i in whole.tolist() if texts[i] not in known], np.int64)
    passages += [texts[i] for i in whole.tolist()]
    length = np.fromiter(map(len, passages), np.int64, len(passages))
    count = np.concatenate([np.full(len(single), LENGTH), t_n[whole] + LENGTH - 1])
    lo = np.concatenate([low[spread], least[whole]])
    if not passages:
        none = np.zeros(0, np.int64)
        return spans_out(bucket, none, none, none, LENGTH, groups)
    # all segments stream through automata of some passages each, a line a segment: no word holds a line break
    stream = (b" " + b"\n ".join(texts)).decode("latin-1")
    hits = np.concatenate([_found(passages[x:y], x, stream) for x, y in document_chunks(np.append(0, np.cumsum(length)), LETTERS)])
    t_size = size[rep]
    line = np.cumsum(t_size + 2) - (t_size + 2) + 1  # where each text starts in the stream
    end, what = hits[:, 0] + 1, hits[:, 1]
    text_of = np.searchsorted(line, end, side="right") - 1
    keep = lo[what] < most[text_of]
    end, what, text_of = end[keep], what[keep], text_of[keep]
    place = begins[word0[text_of]] + end - line[text_of] - length[what]  # in the bucket's content
    first = np.searchsorted(begins, place, side="left") - word0[text_of]
    # every holder of the text with a larger id
    holders = np.argsort(text, kind="stable")
    edge = np.searchsorted(text[holders], np.arange(len(texts) + 1))
    many = (edge[1:] - edge[:-1])[text_of]
    who = holders[ragged(edge[:-1][text_of], many)]
    hit = np.repeat(np.arange(len(what)), many)
    late = doc[who] > lo[what[hit]]
    who, hit = who[late], hit[late]
    return spans_out(bucket, items[who], first[hit], count[what[hit]] - LENGTH + 1, LENGTH, groups)


RESULT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _kept(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[int, list[bytes]]:
    raw = np.frombuffer(text, np.uint8)
    start, end, _ = word_bounds(raw, np.array([0, len(raw)]))
    keep = np.ones(len(start), bool)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        keep[x:y] = False
    return len(start), [text[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]


def digests(docs: DataFrame) -> DataFrame:
    def finish(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        n, kept = _kept(text, a, b)
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return remove_repeats(docs, cut, decide, finish, RESULT)
