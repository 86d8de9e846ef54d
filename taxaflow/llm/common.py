"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.storage import ensure_checkpoint_dir  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: the file sizes for a scan. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int, least: int = 8, most: int | None = None) -> int:
    """A number of parts that keeps each near bytes_each of df's stored size, however large df is. most: for partitions whose groups are worked off one by one, so that fewer hold more groups, not larger ones."""
    size = plan_bytes(df)
    if size >= 1 << 60:  # not a scan of files: Catalyst doesn't know, so the texts are measured
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    parts = int(max(least, -(-size // bytes_each)))
    return min(parts, most) if most else parts


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; a null is an empty string."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text (one longer text comes alone)."""
    release()
    yield from _slices(batches, text, limit)
    release()


def _slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def document_chunks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document is one alone."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1))
        yield at, to
        at = to


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes outside \\x20 and \\x09-\\x0D; runs end with their document."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets[:-1]] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for many ranges at once: differences of one prefix sum, shifted to a common origin."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_P, n, "p"), out=total[1:])
        found = (total[end] - total[start]) * _power(_PINV, n + 1, "q")[start]
        return mix(found ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(salt))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[raw]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def short_codes(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each data[start : start + size]: its first 15 bytes and, in the top byte, how many. Ranges of more than 15 bytes have no code of their own yet."""
    words = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))
    low = words[start] & _MASK[np.minimum(size, 8)]
    high = words[np.minimum(start + 8, len(data))] & _MASK[np.clip(size - 8, 0, 7)]
    return low, high | size.astype(np.uint64) << np.uint64(56)


def byte_codes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves that name raw[start : start + size]: up to 15 bytes the bytes and their number, beyond that 127 bits of a BLAKE2 digest. Equal bytes have equal codes; unequal short ones never do."""
    data = raw.tobytes()
    low, high = short_codes(data, start, size)
    long = np.flatnonzero(size > 15)
    if len(long):
        a = start[long].tolist()
        digests = b"".join([hashlib.blake2b(data[x : x + n], digest_size=16).digest() for x, n in zip(a, size[long].tolist(), strict=True)])
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = halves[:, 0], halves[:, 1] | np.uint64(1 << 63)
    return low, high


def distinct_codes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair first stands, which of them each pair is). Sorted by a hash, then compared in full."""
    _, pick, which = np.unique(code_hashes(low, high), return_index=True, return_inverse=True)
    if (low[pick][which] == low).all() and (high[pick][which] == high).all():
        return pick, which
    order = np.lexsort((low, high))  # two pairs share a hash
    new = np.ones(len(order), bool)
    new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def code_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of byte_codes."""
    with np.errstate(over="ignore"):
        return mix(low ^ mix(high + np.uint64(0xD6E8FEB86659FD93)))


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + size] equals raw[b : b + size], for many ranges; some 1 MB of them at a time."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        n = size[at:to]
        unlike = raw[ragged(a[at:to], n)] != raw[ragged(b[at:to], n)]
        out[at:to][np.repeat(np.arange(to - at), n)[unlike]] = False
        at = to
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 for every i, one after another."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(total)
