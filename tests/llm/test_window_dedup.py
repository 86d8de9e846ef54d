"""Byte and word dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from taxaflow.llm import phrase_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, blob string, bucket int, grp int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    passages = [prose(rng.randint(8, 40)) for _ in range(6)]
    out = []
    for i in range(160):
        t = "".join(rng.choice([prose(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))
        out.append((i * 3, t))
    base = prose(150)
    out += [(1000 + i, base[: rng.randint(0, len(base))] + prose(3) + base[rng.randint(0, len(base)) :]) for i in range(20)]
    out += [(2000 + i, base) for i in range(30)] + [(3000, "a" * 400), (3001, "a" * 49), (3002, "a" * 50), (3003, "x " * 60), (3004, "x " * 12), (3005, "x\n" * 13)]
    out += [(4000, None), (4001, ""), (None, base), (None, None), (5000, base + "one"), (5000, base + "two"), (2000, base)]
    rng.shuffle(out)
    return out


def brute(rows, units, window):
    smallest = {}
    for i, u in rows:
        if i is not None:
            for s in range(len(u) - window + 1):
                k = tuple(u[s : s + window])
                smallest[k] = min(smallest.get(k, i), i)
    for i, u in rows:
        gone = [False] * len(u)
        if i is not None:
            for s in range(len(u) - window + 1):
                if smallest[tuple(u[s : s + window])] < i:
                    gone[s : s + window] = [True] * window
        yield i, u, gone


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, 2) for i, t in rows], SCHEMA).repartition(4)


def test_bytes(spark, rows):
    got = sorted(tuple(str(x) for x in r) for r in suffix_dedup.digests(frame(spark, rows)).collect())
    want = []
    for i, u, gone in brute([(i, (t or "").encode()) for i, t in rows], None, 50):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), str(len(u)), str(sum(gone)), str(runs), hashlib.sha256(bytes(b for b, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)
    assert suffix_dedup.digests(frame(spark, [])).count() == 0


def test_words(spark, rows):
    got = sorted(tuple(str(x) for x in r) for r in phrase_dedup.digests(frame(spark, rows)).collect())
    want = []
    for i, u, gone in brute([(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows], None, 13):
        want.append((str(i), str(len(u)), str(sum(gone)), hashlib.sha256(b" ".join(w for w, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)
    assert phrase_dedup.digests(frame(spark, [])).count() == 0


def doubling(letters, bits):
    """A word of 2 ** bits letters that doubles with its letters swapped, and its complement: equal under polynomial hashes modulo 2^64."""
    word, other = letters
    for _ in range(bits):
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("bits", [9, 10, 12])
def test_unlike_words_stay(spark, bits):
    x, y = doubling("ab", bits)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{y} {rest}"), (4, x * 2), (5, y * 2)]
    got = {r.doc_id: r.n_removed for r in phrase_dedup.digests(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digests(frame(spark, rows)).collect()}
    want = {i: sum(gone) for i, _, gone in brute([(i, t.encode()) for i, t in rows], None, 50)}
    assert got == want


def test_very_long_text(spark):
    rng = random.Random(6)
    words = [f"x{rng.randrange(9000)}" for _ in range(80_000)]
    rows = [(9, " ".join(words)), (4, " ".join(words[20_000:60_000])), (6, " ".join(reversed(words)))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrase_dedup.digests(frame(spark, rows)).collect()}
    assert got == {9: (80_000, 40_000), 4: (40_000, 0), 6: (80_000, 0)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(frame(spark, rows)).collect()}
    inner = len(rows[1][1])
    before, after = words[20_000 - 1], words[60_000]
    assert got[4][1] == got[6][1] == 0 and got[9][0] == len(rows[0][1]) and got[9][2] == 1
    assert inner <= got[9][1] <= inner + 2 and before and after


@pytest.mark.parametrize("shallow", [8, 24])
def test_deep_shallow_sort(shallow):
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab\0") for _ in range(300)) + b"abc" * 60 + b"a" * 100
    at = np.array([rng.randrange(len(raw)) for _ in range(600)])
    size = np.array([min(rng.choice([0, 5, 8, 30, 90]), len(raw) - a) for a in at.tolist()])
    order, new = suffix_dedup.deep_shallow_sort(np.frombuffer(raw, np.uint8), at, size, shallow)
    s = [raw[at[i] : at[i] + size[i]] for i in order]
    assert s == sorted(s) and sorted(order.tolist()) == list(range(600))
    assert new.tolist() == [k == 0 or s[k] != s[k - 1] for k in range(600)]
