"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from taxaflow.llm import ngram_join
from taxaflow.llm.components import connected_components

SCHEMA = "doc_id long, text string, node long, bucket string"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "The", "the"]
    out = []
    for b in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 11, 12, 40, 150, 300]))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t) if rng.random() < 0.7 else "\n".join(t).upper())
    out += [None, "", " ", "one", "ONE", "one two", "one  two", "a b c", "a b c d"] + ["same text over and over again"] * 5
    out = [(i * 2, t) for i, t in enumerate(out)]
    return out + [(None, out[0][1]), (0, "other words entirely here")]


@pytest.mark.parametrize(("floor", "hot"), [(512, 1 << 15), (2, 1 << 15), (2, 1)])
def test_components(spark, rows, floor, hot, monkeypatch):
    if floor == 2:  # nearly every token is of the frequent class
        monkeypatch.setattr(ngram_join, "int", lambda x: 2 if isinstance(x, float) else int(x), raising=False)
    if hot == 1:  # keys are split by node, and blocks are small
        monkeypatch.setattr(ngram_join, "BLOCK", 3)
        monkeypatch.setattr(ngram_join, "LIMIT", 0)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df, hot=hot).collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)
    assert got == want


def test_empty(spark):
    assert ngram_join.link_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 300), (300, 250)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 300: 200, 250: 200}


def test_components_cut_off_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(edges, most=1)


def doubling(letters, bits):
    """A word of 2 ** bits letters that doubles with its letters swapped, and its complement: equal under polynomial hashes modulo 2^64."""
    word, other = letters
    for _ in range(bits):
        word, other = word + other, other + word
    return word, other


def test_groups_united(spark, monkeypatch):
    """A family of near copies with a chain of links through it, in groups that are united from two members on."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 200)
    texts = []
    for i in range(90):
        t = list(base)
        for j in range(i // 9):
            t[7 + 19 * j] = f"edit{i}x{j}" if i % 3 else f"edit{j}"
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(" ".join(t)) for t in texts]
    for i in range(90):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(90)}
    assert len(set(want.values())) > 3
    for floor in (1 << 11, 2):
        monkeypatch.setattr(ngram_join, "int", lambda x, floor=floor: floor if isinstance(x, float) else int(x), raising=False)
        assert {r.doc_id: r.component_id for r in ngram_join.link_components(df).collect()} == want


@pytest.mark.parametrize("bits", [9, 10, 12])
def test_unlike_words_do_not_link(spark, bits):
    x, y = doubling("ab", bits)
    rest = " ".join(f"w{i}" for i in range(5))
    docs = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{y} {rest}"), (4, x), (5, y)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_sketches_allow_every_link():
    rng = random.Random(4)
    blobs, sets = [], []
    for n in (3, 40, 700, 2500):
        base = rng.sample(range(1 << 62), n)
        for edits in (0, 1, n // 30, n // 18, n // 2):
            s = set(base[edits:]) | set(rng.sample(range(1 << 62), edits))
            sets.append(s)
            blobs.append(ngram_join.sketch_of(np.array(sorted(s), np.uint64), 90, 100))
    x = ngram_join.Sketches(blobs)
    i, j = (a.ravel() for a in np.indices((len(sets), len(sets))))
    n = np.array([len(s) for s in sets])
    ok = ngram_join.slack(x, i, n[i], x, j, n[j], 90, 100) >= 0
    small = ngram_join.Sketches([ngram_join.small_sketch(np.array(sorted(s), np.uint64), 90, 100) for s in sets])
    order = np.argsort(n, kind="stable")
    some = ngram_join.partnered(np.zeros(len(n)), order, n[order], small, 90, 100)
    linked = np.array([100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)])
    assert ok[linked].all() and not ok.all()
    assert some[[linked[(i == o) & (j != o)].any() for o in order]].all()


def test_very_long_text(spark):
    rng = random.Random(5)
    words = [f"x{rng.randrange(4000)}" for _ in range(60_000)]
    near = [*words[:30_000], "other", *words[30_000:]]
    docs = spark.createDataFrame([(7, " ".join(words)), (3, " ".join(near)), (5, " ".join(words[:40_000]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()} == {7: 3, 3: 3, 5: 5}
