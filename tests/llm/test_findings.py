"""Cases that once took too much memory."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from taxaflow.llm import byte_bpe, phrase_dedup, suffix_dedup, windows
from taxaflow.llm.common import slices


def test_passages_are_found_by_automata_of_bounded_size(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    shared = [" ".join(rng.choices(words, k=30)) for _ in range(6)]
    texts = [" ".join([*rng.choices(words, k=5), rng.choice(shared), *rng.choices(words, k=5), rng.choice(shared)]).encode() for _ in range(40)]
    off = np.cumsum([0, *map(len, texts)])
    blobs = [b for k, b in phrase_dedup.cut(np.frombuffer(b"".join(texts), np.uint8), off, np.arange(40), np.arange(40).astype(np.uint64), 1, 1) if k >= 0]

    def spans():
        return sorted(zip(*(x.tolist() for b in phrase_dedup.decide(windows.Bucket(blobs), 1).column("blob").to_pylist() for x in windows.unpack(b, "<i8", "<u8", "<i8", "<i8")), strict=True))

    whole, sizes = spans(), []
    made = phrase_dedup._found
    monkeypatch.setattr(phrase_dedup, "LETTERS", 500)
    monkeypatch.setattr(phrase_dedup, "_found", lambda p, *x: sizes.append(sum(map(len, p))) or made(p, *x))
    assert spans() == whole and len(whole) > 40
    assert len(sizes) > 1 and max(sizes) <= 500


def _peak(work) -> float:
    """MB that work() holds at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_of_the_encoder_or_the_byte_dedup_takes_little_memory():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=1500)) for _ in range(300)]
    batch = pa.record_batch({"doc_id": pa.array(range(300)), "text": texts})
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.bpe_of(ranks)
    made = []
    assert _peak(lambda: made.extend(len(bpe.encode(x.column(1).to_pylist())) for x in slices(iter([batch]), limit=byte_bpe.SLICE))) < 60
    assert sum(made) == 300 and len(made) > 2
    raw = np.frombuffer("".join(texts[:100]).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts[:100])])
    assert _peak(lambda: made.extend(suffix_dedup.cut(raw, off, np.arange(100), np.arange(100).astype(np.uint64), 8, 8))) < 15
