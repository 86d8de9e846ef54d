"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals become document scores and spans.

Labels come for documents, so tokens are labelled first: in a toxic document, a token is toxic if documents that hold its
word (or its first bytes) are toxic far more often than others. The field has two states, weights of hashed features of
each token (word, first 4, 5 and 6 bytes) and transitions, and is trained by gradient ascent on the conditional likelihood
of the labelled tokens. Forward-backward runs over chunks of all documents side by side: chunk matrices first, a short
scan over each document's chunks, then the messages inside the chunks. A logistic curve over a document's marginals,
fitted on the training documents and corrected to the labels' own share of toxic rows, gives the score.

Training reads a bounded sample: up to `most` toxic and 2 * `most` other labelled rows, those of least crc32(doc_id),
held-out rows excluded. Its whole texts stay on the executors, in slices of 2 MB: statistics and gradients are summed
there by piece of the weight table, and the driver holds one weight a feature. Scoring is one narrow pass over all
documents; the model is 8 MB. A text is one unit of work, however long.

Null text is empty; an empty text scores like a text without toxic tokens. Labels that are null or without a document are
not used; with no labels of both kinds every score is the share of toxic labels (0 if none). Rows whose crc32 is equal
are taken in the order of their doc_id; of rows that share a doc_id each is trained on and scored. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import ensure_checkpoint_dir, mix, slices, utf8_buffers
from taxaflow.llm.windows import pack, unpack

BITS = 22
CHUNK = 128
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def tokens_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of letter runs: A-Z, a-z and bytes of other characters."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens x 4 cells of the weight table, in lower case: the word, its first 4, 5 and 6 bytes (the word again where shorter)."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    words = np.ndarray((len(raw) + 9,), "<u8", low.tobytes() + bytes(16), 0, (1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    size = end - start
    head = words[start] & mask[np.minimum(size, 8)]
    rest = words[np.minimum(start + 8, len(raw))] & mask[np.clip(size - 8, 0, 8)]
    with np.errstate(over="ignore"):
        code = mix(head) + mix(rest + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cells = [code] + [mix((head & mask[np.minimum(size, k)]) + np.uint64(k) * np.uint64(0xD6E8FEB86659FD93)) for k in (4, 5, 6)]
    return np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cells], axis=1)


def marginals(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(P(token toxic), expected transitions 2 x 2) of all documents. emit: log-odds of each token; bounds: each document's first token, and the end."""
    n = len(emit)
    size = np.diff(bounds)
    chunks = -(-size // CHUNK)
    total = int(chunks.sum())
    if not n:
        return emit, np.zeros((2, 2))
    base = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(size)), size)
    k = np.arange(n) - bounds[doc]
    col, row = base[doc] + k // CHUNK, k % CHUNK
    # psi[t][i][j]; padding is the identity
    a = np.exp(trans)
    w = np.exp(np.clip(emit.astype(np.float64), -30, 30))
    psi = np.zeros((2, 2, CHUNK, total))
    psi[0, 0] = psi[1, 1] = 1
    for i in range(2):
        for j in range(2):
            psi[i, j, row, col] = a[i, j] * (w if j else 1.0)
    begin = bounds[:-1][size > 0]
    for j in range(2):
        v = np.exp(first[j]) * (w[begin] if j else 1.0)
        psi[0, j, 0, base[size > 0]] = psi[1, j, 0, base[size > 0]] = v
    m = np.zeros((2, 2, total))
    m[0, 0] = m[1, 1] = 1
    for t in range(CHUNK):
        p = psi[:, :, t]
        m = np.stack([m[:, 0] * p[0, j] + m[:, 1] * p[1, j] for j in range(2)], axis=1)
        m /= m.sum((0, 1)) * 0.5
    start, stop = np.empty((2, total)), np.empty((2, total))
    f = np.full((2, len(size)), 0.5)
    b = np.full((2, len(size)), 0.5)
    for c in range(int(chunks.max())):
        d = np.flatnonzero(chunks > c)
        x = base[d] + c
        start[:, x] = f[:, d]
        f[:, d] = np.stack([f[0, d] * m[0, j, x] + f[1, d] * m[1, j, x] for j in range(2)])
        f[:, d] /= f[:, d].sum(0)
        x = base[d] + chunks[d] - 1 - c
        stop[:, x] = b[:, d]
        b[:, d] = np.stack([m[i, 0, x] * b[0, d] + m[i, 1, x] * b[1, d] for i in range(2)])
        b[:, d] /= b[:, d].sum(0)
    alpha, beta = np.empty((CHUNK + 1, 2, total)), np.empty((CHUNK + 1, 2, total))
    alpha[0], beta[CHUNK] = start, stop
    for t in range(CHUNK):
        p, x = psi[:, :, t], alpha[t]
        y = np.stack([x[0] * p[0, j] + x[1] * p[1, j] for j in range(2)])
        alpha[t + 1] = y / y.sum(0)
    for t in range(CHUNK - 1, -1, -1):
        p, x = psi[:, :, t], beta[t + 1]
        y = np.stack([p[i, 0] * x[0] + p[i, 1] * x[1] for i in range(2)])
        beta[t] = y / y.sum(0)
    post = alpha[1:] * beta[1:]
    post = (post[:, 1] / post.sum(1))[row, col]
    if not pairs:
        return post, np.zeros((2, 2))
    pair = alpha[:-1].transpose(1, 0, 2)[:, None] * psi * beta[1:].transpose(1, 0, 2)[None]
    pair /= pair.sum((0, 1))
    inner = np.ones(n, bool)
    inner[begin] = False
    return post, pair[:, :, row[inner], col[inner]].sum(2)


def in_batches(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = True, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """marginals() over `size` documents at a time, for bounded memory."""
    out, two = np.empty(len(emit)), np.zeros((2, 2))
    for a in range(0, len(bounds) - 1, size):
        part = bounds[a : a + size + 1]
        p, q = marginals(emit[part[0] : part[-1]], part - part[0], trans, first, pairs)
        out[part[0] : part[-1]] = p
        two += q
    return out, two


def chunk_posteriors(emit: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    return marginals(emit, bounds, model.trans, model.first, pairs=False)[0]


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    curve: np.ndarray  # logistic weights of document_values, then the constant


def document_values(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Documents x 3: log of 1 + expected toxic tokens, the largest marginal, and expected toxic tokens up to 4."""
    total = np.bincount(doc, p, n)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.log1p(total), most, np.minimum(total, 4)], axis=1)


#: Pieces of the weight table that are summed side by side; partitions of the labelled sample.
PIECES, PARTS = 16, 24
#: A token of a toxic document is labelled toxic where its feature's odds are e ** LIFT times the sample's and ERRORS standard errors above them.
LIFT, ERRORS = 3.0, 4.0


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature cells, document of each token, each document's first token and the end, toxic by document, documents) of a batch of (toxic, text)."""
    raw, off = utf8_buffers(batch.column(1))
    start, end, doc = tokens_of(raw, off)
    n = batch.num_rows
    return features(raw, start, end), doc, np.searchsorted(doc, np.arange(n + 1)), batch.column(0).to_numpy() == 1, n


def _reduced(rows: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], add: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, values, totals) over the sample. work: a slice's (cells, one row of values a cell, totals); add: (cells, values, totals) of all slices in one piece -> (cells, values) of that piece.

    Tasks read slices of bounded bytes; their values meet by piece of the table, in a fixed order, and only one row a cell reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", 2 << 20)):
            cells, values, totals = work(batch)
            order = np.argsort(cells, kind="stable")
            cells, values = cells[order], values[order]
            edges = np.searchsorted(cells, np.arange(PIECES + 1) << (BITS - 4))
            blobs = [pack(cells[a:b].astype("<u4"), values[a:b].astype("<f8"), totals.astype("<f8")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part + k] * PIECES, pa.int64()), pa.array(blobs, pa.binary())], names=["piece", "at", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        parts = [unpack(b, "<u4", "<f8", "<f8") for _, b in sorted(zip(group.column("at").to_pylist(), group.column("blob").to_pylist(), strict=True))]
        totals = np.sum([t for _, _, t in parts], axis=0)
        cells = np.concatenate([c for c, _, _ in parts])
        found, out = add(cells, np.concatenate([v for _, v, _ in parts]).reshape(len(cells), -1), totals)
        return pa.table({"piece": group.column("piece").slice(0, 1), "blob": pa.array([pack(found.astype("<u4"), out.astype("<f4"), totals)], pa.binary())})

    got = rows.mapInArrow(run, "piece int, at long, blob binary").groupBy("piece").applyInArrow(meet, "piece int, blob binary").collect()  # 16 rows
    parts = [unpack(bytes(r["blob"]), "<u4", "<f4", "<f8") for r in sorted(got, key=lambda r: r["piece"])]
    cells = np.concatenate([c for c, _, _ in parts])
    return cells, np.concatenate([v for _, v, _ in parts]).reshape(len(cells), -1), parts[0][2]


def _sum(cells: np.ndarray, values: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(cells, return_inverse=True)
    return found, np.stack([np.bincount(at, v, len(found)) for v in values.T], axis=1) if len(found) else values


def toxic_cells(rows: DataFrame, least_lift: float = LIFT, errors: float = ERRORS) -> np.ndarray:
    """Features whose holders are toxic far more often than others: documents that hold them, and, since copies of one text repeat their neighbours, distinct words before them."""

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, doc, _, toxic, n = _tokens(batch)
        held = np.unique(cells.ravel().astype(np.int64) * n + np.repeat(doc, 4))
        # a row a holder: (-1 or the word before, toxic)
        near = np.append(0, cells[:-1, 0]) % 4093 if len(cells) else cells[:, 0]
        pairs = np.unique((cells.astype(np.int64) * 4093 + near[:, None]) * 2 + toxic[doc][:, None])
        at = np.concatenate([held // n, pairs // 2 // 4093])
        values = np.stack([np.concatenate([np.full(len(held), -1.0), pairs // 2 % 4093]), np.concatenate([toxic[held % n], pairs & 1])], axis=1)
        return at, values, np.array([n, toxic.sum(), len(doc), toxic[doc].sum()], float)

    def add(cells: np.ndarray, values: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(cells, return_inverse=True)
        whole = values[:, 0] < 0
        near = np.unique((at[~whole].astype(np.int64) * 4093 + values[~whole, 0].astype(np.int64)) * 2 + values[~whole, 1].astype(np.int64))

        def far(who: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
            yes, no = np.bincount(who[toxic], minlength=len(found)), np.bincount(who[~toxic], minlength=len(found))
            expected = (yes + no) * share
            return np.log((yes + 0.2) / (no + 0.2)) - np.log(share / (1 - share)), yes - expected > errors * np.sqrt(expected * (1 - share))

        lift, sure = far(at[whole], values[whole, 1] > 0, totals[1] / totals[0])
        _, apart = far(near // 2 // 4093, (near & 1) > 0, float(np.clip(totals[3] / max(totals[2], 1), 0.01, 0.99)))
        keep = (lift > least_lift) & sure & apart
        return found[keep], np.zeros((int(keep.sum()), 0))

    return _reduced(rows, work, add)[0]


def train(rows: DataFrame, share: float, rounds: int = 6, lift: float = LIFT, errors: float = ERRORS) -> Model:
    """A model from (toxic, text) rows; share: toxic rows among all labels. Sums run on the executors, the driver holds one weight and one speed a feature seen."""
    model = Model(np.zeros(1 << BITS, np.float16), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, 0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or n_toxic in (0, n):
        return model
    context = rows.sparkSession.sparkContext
    marked = context.broadcast(toxic_cells(rows, lift, errors))

    def labelled(batch: pa.RecordBatch) -> tuple:
        cells, doc, bounds, toxic, n = _tokens(batch)
        hot = np.zeros(1 << BITS, bool)
        hot[marked.value] = True
        return cells, doc, bounds, toxic, n, toxic[doc] & hot[cells].any(1), bounds[:-1][np.diff(bounds) > 0]

    def count(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, doc, bounds, _, _, label, first = labelled(batch)
        inner = np.ones(len(doc), bool)
        inner[first] = False
        y = label.astype(int)
        pairs = np.bincount(np.append(0, y[:-1])[inner] * 2 + y[inner], minlength=4) if len(y) else np.zeros(4)
        found, at = np.unique(cells.ravel(), return_inverse=True)
        values = np.stack([np.bincount(at, minlength=len(found)), np.bincount(at, np.repeat(label, 4), len(found))], axis=1)
        return found, values, np.concatenate([pairs, [len(y), y.sum(), len(first), y[first].sum()]]).astype(float)

    seen_cells, values, totals = _reduced(rows, count, _sum)
    seen, want = values.T.astype(np.float64)
    want_pairs, n_tokens, n_labels, n_first, y_first = totals[:4].reshape(2, 2), *totals[4:]
    if not n_tokens:
        return model
    rate = max(n_labels / n_tokens, 1e-6)
    bias = np.log(rate / (1 - rate))
    # start from the tokens' own log-odds: the field then learns what neighbours add
    theta = (np.log((want + 2 * rate) / (seen - want + 2)) - bias) / 4
    trans, first = np.zeros((2, 2)), np.array([0.0, bias])
    trans[:, 1] = bias
    speed = np.full(len(theta), 1e-8)

    def weights_of(shipped: Broadcast) -> np.ndarray:
        at, w = shipped.value
        dense = np.zeros(1 << BITS, w.dtype)
        dense[at] = w
        return dense

    for _ in range(rounds):
        shipped = context.broadcast((seen_cells, theta.astype(np.float32)))

        def gradient(batch: pa.RecordBatch, shipped: Broadcast = shipped, trans: np.ndarray = trans.copy(), start: np.ndarray = first.copy()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cells, _, bounds, _, _, label, lead = labelled(batch)
            p, pairs = in_batches(weights_of(shipped)[cells].sum(1, dtype=np.float64), bounds, trans, start)
            found, at = np.unique(cells.ravel(), return_inverse=True)
            return found, np.bincount(at, np.repeat(label - p, 4), len(found))[:, None], np.concatenate([pairs.ravel(), [p[lead].sum()]])

        _, got, totals = _reduced(rows, gradient, _sum)
        shipped.unpersist()
        g = got[:, 0] - 0.02 * theta
        speed += g * g
        theta += 0.5 * g / np.sqrt(speed)
        gp = (want_pairs - totals[:4].reshape(2, 2)) / np.maximum(want_pairs.sum(1, keepdims=True), 1)
        trans[:, 1] += np.clip(gp[:, 1] / np.maximum(0.05, np.abs(gp[:, 1]) * 4 + rate), -0.5, 0.5)
        first[1] += np.clip((y_first - totals[4]) / n_first / 0.05, -0.5, 0.5)
    model.weights[seen_cells], model.trans, model.first = theta.astype(np.float16), trans, first
    shipped = context.broadcast((seen_cells, theta.astype(np.float16)))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            cells, doc, bounds, toxic, n = _tokens(batch)
            p = in_batches(weights_of(shipped)[cells].sum(1, dtype=np.float64), bounds, trans, first, pairs=False)[0]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.float64()) for v in document_values(p, doc, n).T), pa.array(toxic)], names=["a", "b", "c", "toxic"])

    got = np.array(sorted(tuple(r) for r in rows.mapInArrow(valued, "a double, b double, c double, toxic boolean").collect()))  # four numbers a row of the bounded sample
    x, t = np.column_stack([got[:, :3], np.ones(len(got))]), got[:, 3]
    # each class weighs as among all labels
    weight = np.where(t > 0, share / max(t.mean(), 1e-9), (1 - share) / max(1 - t.mean(), 1e-9))
    c = np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 1e-3])
    for _ in range(25):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge
        c = c + np.linalg.solve(h, x.T @ (weight * (t - q)) - ridge @ c)
    model.curve = c
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 1500, lift: float = LIFT, errors: float = ERRORS) -> Model:
    """Train on a bounded sample of labelled rows that aren't held out: whole texts, dealt to PARTS partitions and read there in slices. docs may be fewer than the labels."""
    ensure_checkpoint_dir(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    by = [F.crc32(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*by).limit(most).unionByName(usable.where("toxic = 0").orderBy(*by).limit(2 * most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 3 * most labels: two numbers each
    rows = rows.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "toxic", "text").select("toxic", "text").checkpoint()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(rows, share, lift=lift, errors=errors)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, n_toxic (expected toxic tokens), spans (start, end in code points of tokens with a marginal of a half or more, neighbours joined); columns in keep follow doc_id as kept_0, kept_1 ..."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches, "text", 2 << 20):
            raw, off = utf8_buffers(batch.column(1))
            n = batch.num_rows
            start, end, doc = tokens_of(raw, off)
            p = chunk_posteriors(model.weights[features(raw, start, end)].sum(1, dtype=np.float64), np.searchsorted(doc, np.arange(n + 1)), model)
            values = np.column_stack([document_values(p, doc, n), np.ones(n)])
            score = 1 / (1 + np.exp(-np.clip(values @ model.curve, -30, 30)))
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            hit = np.flatnonzero(p >= 0.5)
            if len(hit):
                point = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
                last = -2
                for h, d, a, b in zip(hit.tolist(), doc[hit].tolist(), (point[start[hit]] - point[off[doc[hit]]]).tolist(), (point[end[hit]] - point[off[doc[hit]]]).tolist(), strict=True):
                    if h == last + 1 and spans[d]:
                        spans[d][-1] = (spans[d][-1][0], b)
                    else:
                        spans[d].append((a, b))
                    last = h
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(doc, p, n)), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], names=["doc_id", *names, "score", "predicted", "n_toxic", "spans"])

    names = [f"kept_{i}" for i in range(len(keep))]
    kinds = "".join(f"{c} {docs.schema[k].dataType.simpleString()}, " for c, k in zip(names, keep, strict=True))
    return docs.select("doc_id", "text", *(F.col(k).alias(c) for c, k in zip(names, keep, strict=True))).mapInArrow(run, f"doc_id long, {kinds}score double, predicted int, n_toxic double, spans array<struct<start: long, end: long>>")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """documents without those predicted toxic; every other row and column stays."""
    model = fit(docs, labels)
    keep = tuple(c for c in docs.columns if c != "doc_id")
    return score(docs, model, threshold, keep).where("predicted = 0").select(*(F.col("doc_id") if c == "doc_id" else F.col(f"kept_{keep.index(c)}").alias(c) for c in docs.columns))
