"""The CRF against enumeration, and held-out accuracy."""

import itertools
import zlib

import numpy as np

from taxaflow.llm import toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 9, 0, 7]
    emit = rng.normal(0, 2, sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    trans, first = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    for chunk in (3, 128):
        toxicity.CHUNK, old = chunk, toxicity.CHUNK
        p, pairs = toxicity.marginals(emit, bounds, trans, first)
        toxicity.CHUNK = old
        want, two = np.zeros(len(emit)), np.zeros((2, 2))
        for a, b in itertools.pairwise(bounds):
            states = list(itertools.product((0, 1), repeat=b - a))
            if b == a:
                continue
            w = np.array([np.exp(first[s[0]] + sum(trans[x, y] for x, y in itertools.pairwise(s)) + sum(e * x for e, x in zip(emit[a:b], s, strict=True))) for s in states])
            w /= w.sum()
            want[a:b] = np.array(states).T @ w
            for s, q in zip(states, w, strict=True):
                for x, y in itertools.pairwise(s):
                    two[x, y] += q
        assert np.allclose(p, want) and np.allclose(pairs, two)


def rows(n=400):
    rng = np.random.default_rng(1)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        t = list(rng.choice(words, 60))
        if bad:
            for k in rng.integers(0, 60, 4):
                t[k] = rng.choice(["Zorgg", "blarfish", "zorgg"])
        out.append((i, " ".join(t), int(bad)))
    return out


def test_scores(spark):
    r = rows()
    docs = spark.createDataFrame([(i, t, 5, "x", "y") for i, t, _ in r] + [(9001, "", 1, "a", "b"), (9002, None, 1, "a", "b"), (None, "zorgg blarfish", 1, "a", "b"), (3, r[3][1], 1, "a", "b"), (9003, "é! " + "Zorgg blarfish" + " é" * 3000, 1, "", "")], "doc_id long, text string, score int, toxic string, lang string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in r] + [(None, 1, 1), (1, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(r) + 5 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    by = {x.doc_id: x for x in got}
    held = [i for i, _, _ in r if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {x.doc_id for x in got if x.held_out and x.doc_id is not None and x.doc_id < 9000} == set(held) and len(held) > 50
    assert all(by[i].predicted == r[i][2] for i in held)
    assert by[9001].predicted == by[9002].predicted == 0 and by[None].predicted == 1
    assert [(s.start, s.end) for s in by[9003].spans] == [(3, 17)]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted == 0 for x in got)
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    assert {x.predicted for x in toxicity.scores(docs, labels.limit(0)).collect()} == {0}
