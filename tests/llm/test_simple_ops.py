"""Operators on single rows, searches and mixing against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from taxaflow.llm import avi_media, byte_bpe, chat_template, kdtree_topk, mixing, queries, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard int"
RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", None, "x", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    al = "ab'srtvelmd  \n\t'!?1½é中\x1c \r"
    out = ["".join(rng.choice(al) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return [None, "", " ", "a" * 3000, "'" * 50, " " * 300, "don't we'll 'S 's's", out[0], out[0], "x" * 576, "y" * 577, *out]


def test_bpe_equals_tiktoken(spark, texts):
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(spark, texts), RANKS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(ENC.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)
    assert byte_bpe.digests(docs_of(spark, []), RANKS).count() == 0


@pytest.mark.parametrize("bits", [4, 5, 9, 10, 12])
def test_bpe_of_words_that_hash_alike(spark, bits):
    x, y = "a", "b"
    for _ in range(bits):  # equal under polynomial hashes modulo 2^64 from 10 doublings on
        x, y = x + y, y + x
    words = [x, y, f"{x} {y} {x}", f"{y}, {x}", (x + y) * 9]
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(spark, words), RANKS).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(spark, words), RANKS).collect()}
    for i, t in enumerate(words):
        ids = np.array(ENC.encode_ordinary(t), "<u4")
        assert (got[i].ids_sha256, got[i].decoded_sha256) == (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert counts[i] == len(ids)


def test_bpe_column_keeps_names_and_offsets(spark):
    got = byte_bpe.encode_column(docs_of(spark, ["it's two words"]), RANKS, offsets=True).first()
    assert got.slice_starts == [0, 2, 4, 8] and got.shard == 3


def test_token_counts(spark, texts):
    d = docs_of(spark, texts).repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, RANKS, block=64).collect()}
    assert got == {i: len(ENC.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs_of(spark, []), RANKS).count() == 0


def test_separator_scan_with_tail(spark):
    rng = random.Random(3)
    stream = [rng.choice([7, 8, 9, 9]) for _ in range(500)] + [7, 7]
    for block in (1, 5, 64, 1000):
        blocks = [(4, b, np.array(stream[a : a + block], "<u2").tobytes()) for b, a in enumerate(range(0, len(stream), block))]
        got = token_counts.scan(spark.createDataFrame(blocks, "file long, block_no long, tokens binary"), 9, tail=True).collect()
        want = [len(x) for x in "".join(map(str, stream)).split("9")]
        assert [r.n_tokens for r in sorted((r for r in got if r.doc_no is not None), key=lambda r: r.doc_no)] == want[:-1]
        assert [r.n_tokens for r in got if r.doc_no is None] == [want[-1]]


def chat_expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for c, g in groups.items():
        g = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in g))
        turns = "".join(f"{r}\n{x}\n" for *_, r, x in g)
        loss = "".join(x for *_, r, x in g if r == "assistant")
        out[c] = (len(g), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("source", [chat_template.SOURCE, chat_template.SOURCE + "{# whole #}{% if messages | length == 0 %}x{% endif %}"])
def test_chat(spark, source):
    rng = random.Random(2)
    words = ["###", "### ", "</turn>", " </turn>\n", "\\", ": ", "a", "é", "\n", "assistant", "### assistant: "]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "", None, "### x: \\"]), rng.choice([None, "", "".join(rng.choice(words) for _ in range(8))])) for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"t{t} " * 50) for t in range(700)] + [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (6, None, "user", "null turn")]
    rows += [(-7, t, r, queries.EXTRA_TURN) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, n int").repartition(5)
    for parts in (1, 7):
        got = chat_template.format_conversations(df, source, parts=parts).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == chat_expected(rows) and len(got) == len({r[0] for r in rows})
    assert chat_template.format_conversations(df.limit(0), source, parts=2).count() == 0


def test_template_language():
    t = chat_template.Template("{% for m in messages %}{% if loop.first and true %}<s>{% elif m.role in 'ab' %}{{ 'x' ~ 'y' | upper }}{% else %}{{ m.none | default('-') }}{% endif %}{% if false %}no{% endif %}{% endfor %}")
    assert t.render([{"role": "q"}, {"role": "a"}, {"role": "z"}])[0] == "<s>xY-" and not t.turn_local
    assert chat_template.Template("{{ 'a' + 'b' }}c").tree == [chat_template.Text("abc")]
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{{ x | nope }}", "{% for %}{% endfor %}", "{% if x %}", "{{ x[0] }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.Template(bad)


def test_media_round_trip(spark, texts):
    got = {r.doc_id: r for r in avi_media.media_digests(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature


def test_frames_decode_bit_by_bit_and_shots(spark):
    rng = np.random.default_rng(1)
    frames = np.concatenate([rng.integers(0, 256, (2, 24, 24), np.uint8), np.full((6, 24, 24), 10, np.uint8), np.full((6, 24, 24), 200, np.uint8)])
    jpegs = avi_media.encode_frames(frames)
    assert (avi_media.decode_frames(jpegs) == frames).all()
    assert all((avi_media.decode_lossless(j) == f).all() for j, f in zip(jpegs, frames, strict=True))
    data = avi_media.write_avi(avi_media.encode_frames(frames[2:]))
    assert [c[1:3] for c in avi_media.clips(data)] == [(0, 6), (6, 6)]
    cut = data.index(b"idx1")
    assert avi_media.read_avi(data[:cut])["frames"] == avi_media.read_avi(data)["frames"]
    assert avi_media.clip_rows(spark.createDataFrame([(1, data), (2, None)], "doc_id long, media binary")).count() == 2


def test_top_k(spark):
    rng = random.Random(4)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 0.25, rng.random()]) for _ in range(5)] for _ in range(400)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(400, None, 1), (420, [1.0, None, 0.0, 0.0, 0.0], 1), (440, [float("nan")] * 5, 1), (460, [float("inf")] * 5, 1), (480, [1.0] * 3, 1), (None, [1.0] * 5, 1), (0, vectors[0], 1)]
    rows += [(1000 + i, [0.5] * 5, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    valid = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for i, v in valid:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in valid if j != i and len(w) == len(v))[:20]
            want |= {(i, r + 1): (j, -x) for r, (x, j) in enumerate(s)}
    for sample, shard in ((1, 64), (200, 100), (2048, 4096)):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree_topk.top_k(df, shard_rows=shard, sample=sample, block=7).collect()}
        assert got == want
    assert kdtree_topk.top_k(df.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(6)
    sources = ["hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None]) for i in range(900)]
    texts = [None if i == 5 else "w " * rng.choice([0, 1, 5, 40, 400]) for i in range(900)]
    texts[7] = "w " * 20000
    df = docs_of(spark, texts, sources)
    rows = mixing.mix(df, shard_docs=50).collect()
    assert sorted(rows) == sorted(mixing.mix(df.repartition(7), shard_docs=50).collect())
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in rows} == size and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    names = sorted(set(sources), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[i] for i in range(900) if sources[i] == s) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 2 * total[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    for s in names:
        of = [r for r in rows if sources[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 * target[s] and r.source_size == total[s] for r in of)
        assert abs(sum(r.taken for r in of) - target[s]) <= 0.01 * target[s] + 64
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_sainte_lague_is_highest_quotient(spark):
    rng = random.Random(8)
    for seats in (0, 1, 7, 100, 1234):
        votes = [rng.randint(0, 1000) for _ in range(13)]
        got = {r.k: r.got for r in mixing.sainte_lague(spark.createDataFrame([(1, k, float(v), seats, 10**9) for k, v in enumerate(votes)], "g int, k int, v double, s long, c long"), ["g"], ["k"], "v", "s", "c").collect()}
        want = dict.fromkeys(range(13), 0)
        for _ in range(seats):
            want[max(range(13), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == want


def test_feature_lists_every_cut(spark):
    text = ("a" * (avi_media.FRAME * 10) + "z" * (avi_media.FRAME * 10)) * 10
    feature = avi_media.media_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().feature
    assert f";clips=20;cuts={','.join(map(str, range(10, 200, 10)))};" in feature
