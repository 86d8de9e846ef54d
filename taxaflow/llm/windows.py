"""Exact search for repeated fixed-length windows, shared by the byte and the word dedup.

A window is W consecutive units (bytes or words) of one document. Which windows also start in a document with a smaller
id is decided by content alone, so equal windows must meet. Every window is named by its minimizer, the k-gram of least
hash in it; neighbouring windows mostly share one and travel together as a segment of n + W - 1 units. Equal windows have
equal minimizers and so reach the same bucket. Segments that repeat within a slice of the scan are combined before the
shuffle, after their bytes are compared: only the smallest id's copy is sent, and the others' spans go straight to the
last step. A passage that a third of all documents share so costs one segment for each slice.

Steps: map (slices -> compressed blobs by bucket), decide (one bucket at a time), apply (spans meet their documents in
groups of bounded size). A bucket or group holds a few MB whatever the table's size; the number of both grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import mix, parts_for, ragged, release, same_bytes, slices, utf8_buffers

_PRIME = 2147483647


def doc_bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(_PRIME)) * F.lit(2654435761), F.lit(_PRIME)), F.lit(n)).cast("int")


def doc_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    return ids % _PRIME * 2654435761 % _PRIME % n


def checksum(text: bytes | np.ndarray) -> int:
    """Tells rows that share a doc_id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays in one compressed blob."""
    data = np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes() + b"".join(x.tobytes() for x in arrays)
    return zstandard.compress(data, level)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, "<i8", len(kinds), 8).tolist()
    out, at = [], 8 + 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of keys[i : i + w] for every i where it fits: prefix and suffix minima of blocks of w."""
    n = len(keys)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = np.ascontiguousarray(padded.reshape(rows, w).T)  # accumulate over whole rows
    ahead = np.minimum.accumulate(grid, axis=0).T.reshape(-1)
    back = np.minimum.accumulate(grid[::-1], axis=0)[::-1].T.reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(grams: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(first unit, windows, document, minimizer's unit, minimizer hash) of runs of windows that share a minimizer.

    grams[i]: hash of units i .. i + k - 1; bounds: each document's first unit, and the end. Ties take the leftmost.
    """
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    if not count.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64)
    keys = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(keys, window - k + 1)
    starts = ragged(bounds[:-1], count)
    of = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first = starts[at]
    return first, np.diff(np.append(at, len(starts))), np.searchsorted(bounds, first, side="right") - 1, (of[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), of[at] >> np.uint64(32)


#: What a blob of segments holds: documents' ids, checksums and numbers of segments; of each segment the step of its first unit, its windows, the minimizer's place, and the bytes of content beyond the least such number; the content.
BLOB = ("<i8", "<u8", "<u4", "<u4", "<u2", "<u2", "<i8", "<u4", "u1")


def span_blobs(ids: np.ndarray, sums: np.ndarray, a: np.ndarray, b: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(document group, packed spans of units [a, b)); spans that touch are joined."""
    group = doc_buckets(ids, groups)
    order = np.lexsort((a, sums, ids, group))
    ids, sums, a, b, group = ids[order], sums[order], a[order], b[order], group[order]
    key = np.ones(len(ids), bool)
    key[1:] = (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1])
    start = np.flatnonzero(key)
    shift = (np.cumsum(key) - 1) * (int(b.max(initial=0)) + 1)  # spans of different documents never touch
    reach = np.maximum.accumulate(b + shift)
    new = key.copy()
    new[1:] |= (a + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    ids, sums, a, b, group = ids[at], sums[at], a[at], (reach[np.append(at[1:], len(reach)) - 1] - shift[at]) if len(start) else b, group[at]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(group[x]), pack(ids[x:y], sums[x:y].astype("<u8"), a[x:y], b[x:y])


def emit(first: np.ndarray, n: np.ndarray, doc: np.ndarray, least: np.ndarray, code: np.ndarray, bounds: np.ndarray, same: np.ndarray, ids: np.ndarray, sums: np.ndarray, content_at: np.ndarray, content_len: np.ndarray, raw: np.ndarray, buckets: int, groups: int, window: int, level: int = 5) -> Iterator[tuple[int, bytes]]:
    """Blobs of segments by bucket, and by -1 - document group the spans decided here: segments whose bytes are those of one with a smaller id in the slice. same: a hash of each segment's content, to find such pairs."""
    order = np.lexsort((ids[doc], same))
    lead = np.ones(len(order), bool)
    lead[1:] = same[order[1:]] != same[order[:-1]]
    head = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    later = (ids[doc[order]] > ids[doc[head]]) & (content_len[order] == content_len[head])
    order, head = order[later], head[later]
    equal = same_bytes(raw, content_at[order], content_at[head], content_len[order])
    decided = np.zeros(len(doc), bool)
    decided[order[equal]] = True
    gone = np.flatnonzero(decided)
    if len(gone):
        a = first[gone] - bounds[doc[gone]]
        for g, blob in span_blobs(ids[doc[gone]], sums[doc[gone]], a, a + n[gone] + window - 1, groups):
            yield -1 - g, blob
    left = np.flatnonzero(~decided)
    bucket = ((code[left] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")  # segments come in the order of their documents
    left, bucket = left[by], bucket[by]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s = left[a:b]
        used, at, many = np.unique(doc[s], return_index=True, return_counts=True)
        step = np.diff(first[s] - bounds[doc[s]], prepend=0)
        step[at] = first[s][at] - bounds[used]
        extra = content_len[s] - n[s]
        floor = int(extra.min())
        yield int(bucket[a]), pack(ids[used].astype("<i8"), sums[used].astype("<u8"), many.astype("<u4"), step.astype("<u4"), n[s].astype("<u2"), (least[s] - first[s]).astype("<u2"), np.array([floor], "<i8"), (extra - floor).astype("<u4") if extra.max() > floor else np.zeros(0, "<u4"), raw[ragged(content_at[s], content_len[s])], level=level)


class Bucket:
    """All segments of one bucket."""

    def __init__(self, blobs: list[bytes]):
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for blob in blobs:
            ids, sums, many, step, n, offset, floor, extra, content = unpack(blob, *BLOB)
            n = n.astype(np.int64)
            total = np.cumsum(step.astype(np.int64))
            begin = np.cumsum(many.astype(np.int64)) - many
            first = total - np.repeat(total[begin] - step[begin], many)
            size = n + floor[0] + (extra if len(extra) else 0)
            for c, x in zip(cols, (np.repeat(ids, many), np.repeat(sums, many), first, n, offset.astype(np.int64), size, content), strict=True):
                c.append(x)
        self.doc, self.sum, self.first, self.n, self.offset, self.size, self.content = (np.concatenate(c) for c in cols)
        self.at = np.cumsum(self.size) - self.size


def spans_out(bucket: Bucket, item: np.ndarray, window_first: np.ndarray, windows: np.ndarray, window: int, groups: int) -> pa.Table:
    """Removed runs (unit spans) packed by document group. item: the segment; window_first: its first removed window; windows: how many."""
    a = bucket.first[item] + window_first
    found = list(span_blobs(bucket.doc[item], bucket.sum[item], a, a + windows + window - 1, groups))
    return pa.table({"grp": pa.array([g for g, _ in found], pa.int32()), "blob": pa.array([b for _, b in found], pa.binary())})


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1]


def packed_texts(docs: DataFrame, groups: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, grp, packed (the text as UTF-8, zstandard) and the columns in keep: what is shuffled where texts meet findings about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5).compress
        for batch in slices(batches, "text", 4 << 20):
            raw, off = utf8_buffers(batch.column(2))
            data = [squeeze(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary()), *batch.columns[3:]], names=["doc_id", "grp", "packed", *keep])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    return docs.select("doc_id", doc_bucket(F.col("doc_id"), groups).alias("grp"), "text", *keep).mapInArrow(run, "doc_id long, grp int, packed binary" + kinds)


def remove_repeats(docs: DataFrame, cut: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int], Iterator[tuple[int, bytes]]], decide: Callable[[Bucket, int], pa.Table], finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], result: pa.Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """The three steps. cut: (bytes, offsets, ids, checksums, buckets, document groups) of a slice -> blobs; decide: a bucket -> packed spans;
    finish: (text as UTF-8, span starts, span ends) -> result values. Columns in keep pass through as they are."""
    buckets = parts_for(docs, 2 << 20)
    groups = parts_for(docs, 2 << 20)
    tasks = parts_for(docs, 8 << 20, 12, 200_000)
    limit = min(24 << 20, max(6 << 20, buckets << 14))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit):
            batch = batch.filter(batch.column(0).is_valid())  # without an id a document is neither smaller nor larger
            if not batch.num_rows:
                continue
            raw, off = utf8_buffers(batch.column(1))
            sums = np.fromiter((checksum(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.uint64, len(off) - 1)
            found = list(cut(raw, off, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sums, buckets, groups))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["bucket", "blob"])

    def second(group: pa.Table) -> pa.Table:
        key = group.column("bucket")[0].as_py()
        if key < 0:  # spans decided by the scan
            return pa.table({"grp": pa.array([-1 - key] * group.num_rows, pa.int32()), "blob": group.column("blob")})
        found = decide(Bucket(group.column("blob").to_pylist()), groups)
        release()
        return found

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple, tuple] = {}
        if right.num_rows:
            parts = [unpack(b, "<i8", "<u8", "<i8", "<i8") for b in right.column("blob").to_pylist()]
            ids, sums, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((a, sums, ids))
            ids, sums, a, b = ids[order], sums[order], a[order], b[order]
            edges = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1])))
            for x, y in zip(edges, np.append(edges[1:], len(ids)), strict=True):
                spans[int(ids[x]), int(sums[x])] = merged(a[x:y], b[x:y])
        none = np.zeros(0, np.int64)
        rows = []
        for i, t in zip(left.column("doc_id").to_pylist(), left.column("packed").to_pylist(), strict=True):
            text = zstandard.decompress(t)
            rows.append(finish(text, *spans.get((i, checksum(text)), (none, none))))
        made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), result, strict=True)] if rows else [pa.array([], f.type) for f in result]
        del rows, spans
        release()
        return pa.table([*(left.column(c) for c in ("doc_id", *keep)), *made], names=["doc_id", *keep, *result.names])

    pieces = docs.select("doc_id", "text").mapInArrow(first, "bucket int, blob binary").repartition(tasks, "bucket")
    spans = pieces.groupBy("bucket").applyInArrow(second, "grp int, blob binary").repartition(tasks, "grp")
    texts = packed_texts(docs, groups, keep).repartition(tasks, "grp")
    kinds = ["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)] if keep else ["doc_id long"]
    sql = {pa.int64(): "long", pa.string(): "string"}
    kinds += [f"{f.name} {sql[f.type]}" for f in result]
    return texts.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(third, ", ".join(kinds))
