"""The pipeline's stages on a small corpus: each judged on its own input."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

from taxaflow.llm import mixing  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text(80).split()
        if i % 4 == 0:
            for k in (3, 20, 50):
                t[k] = rng.choice(["zorgg", "blarfish"])
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    near = text(200).split()
    passage = text(12)
    for i in range(300, 310):
        t = list(near)
        t[i - 300] = "zz"
        rows.append((i, " ".join(t), "en", "s1", 1))
    rows += [(400 + i, f"{text(40)} {passage} {text(30)}", "en", "s2", 1) for i in range(6)] + [(500, None, "en", None, 0), (501, "", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(cp.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
    clean, one, cut, mixed, coded = seen
    assert {r.doc_id for r in clean} == {r[0] for r in rows} - {i for i in range(300) if i % 4 == 0}
    assert {r.doc_id for r in one} == {r.doc_id for r in clean} - set(range(301, 310))
    assert sum(passage in (r.text or "") for r in one) == 6 and [r.doc_id for r in cut if passage in r.text] == [400]
    assert {r.doc_id for r in cut} == {r.doc_id for r in one} and all(r.n_chars == len(r.text) for r in cut)
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}
    assert len(coded) == len(mixed)
    assert sorted(r.decoded_sha256 for r in cp.run(spark, str(tmp_path)).collect()) == sorted(r.decoded_sha256 for r in coded)


def test_near_copies_between_the_thresholds(spark):
    rng = random.Random(10)
    words = [f"w{i}q" for i in range(3000)]
    rows = []
    for base in (0, 10, 20):
        t = rng.sample(words, 200)
        near, far = list(t), list(t)
        for i in range(4):  # 5 words: 176 of 216, 3 words: 186 of 210
            near[20 + 40 * i] = f"near{base}x{i}"
        for i in range(5):  # 5 words: 171 of 221
            far[15 + 38 * i] = f"far{base}x{i}"
        rows += [(base, " ".join(t)), (base + 1, " ".join(near)), (base + 2, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {0, 2, 10, 12, 20, 22}
    assert {r.doc_id for r in cp.ngram_join.keep_one(docs, 3, 90, 100).collect()} == {i for i, _ in rows}
