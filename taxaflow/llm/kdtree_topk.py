"""Exact top-k search with one KD-tree per shard.

Rows are quantised to floor(scale * x) and dealt to shards by a hash of vec_id. A shard's tree splits at the median of
the widest dimension and keeps a tight bounding box and the smallest vec_id of every node. A query walks a tree best
first: a node's bound is the largest inner product any point of its box can reach, and nodes whose bound is below the
query's k-th score so far are skipped. Each query carries a first k-th score, found in a bounded sample of the rows, so
even the first shard it meets prunes with it; a shard sends on only what reaches that score.

Queries go to every shard in blocks; a task holds one tree and one block. What moves is queries x shards, and at most k
rows for each query and shard come back to be ranked.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows without vec_id. Vectors of
another length than the query's are not compared. Rows with the query's vec_id are its own. An exact repeat of a row
counts once. Fewer than k candidates: all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Tree:
    """Points in leaf order with their boxes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 256):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.least, self.span, self.kids = [], [], [], [], []
        index = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(self.span)
            if parent >= 0:
                self.kids[parent][side] = node
            part = self.points[index[a:b]]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[index[a:b]].min()))
            self.span.append((a, b))
            self.kids.append([-1, -1])
            width = high - low
            if b - a > leaf and len(width) and width.max() > 0:
                d = int(width.argmax())
                index[a:b] = index[a:b][np.argsort(part[:, d], kind="stable")]
                m = (a + b) // 2
                stack += [(a, m, node, 0), (m, b, node, 1)]
        self.ids, self.points = self.ids[index], self.points[index]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x nodes: the largest inner product a node's box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """Best k (score, -vec_id) with score >= floor, in a heap. Skipped: bounds below the k-th score, or equal to it with no smaller vec_id."""
        best: list[tuple[float, int]] = []
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            b = -b
            if b < floor or len(best) == k and b < best[0][0]:
                break
            if len(best) == k and b == best[0][0] and self.least[node] > -best[0][1]:
                continue
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(todo, (-bound[left], left))
                heapq.heappush(todo, (-bound[right], right))
                continue
            a, c = self.span[node]
            scores, ids = self.points[a:c] @ query, self.ids[a:c]
            low = max(floor, best[0][0]) if len(best) == k else floor
            hit = np.flatnonzero((scores >= low) & (ids != own))
            if len(hit) > 4 * k:
                hit = hit[np.lexsort((ids[hit], -scores[hit]))[:k]]
            for s, i in zip(scores[hit].tolist(), ids[hit].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return best


def _pack(ids: np.ndarray, points: np.ndarray) -> bytes:
    """Points in the smallest integer type that holds them."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not points.size or (points.min() >= np.iinfo(t).min and points.max() <= np.iinfo(t).max))
    return np.array([len(ids), points.shape[1], np.dtype(kind).itemsize], "<i8").tobytes() + ids.astype("<i8").tobytes() + points.astype(kind).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d, size = np.frombuffer(data, "<i8", 3).tolist()
    ids = np.frombuffer(data, "<i8", n, 24)
    return ids, np.frombuffer(data, f"<i{size}", n * d, 24 + 8 * n).reshape(n, d)


def _exact(points: np.ndarray, queries: np.ndarray) -> type:
    """float64 (and BLAS) while every sum stays exact in it, else int64."""
    most = max((float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0) for x in (points, queries))
    return np.float64 if most * most * max(1, points.shape[1]) < 2**52 else np.int64


def top_k(rows: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, shard_rows: int = 4096, most_shards: int = 4096, block: int = 512, sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k best other rows."""
    spark = rows.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    n = good.count()
    shards = int(min(most_shards, max(1, -(-n // shard_rows))))
    head = good.limit(sample).collect()  # `sample` rows at most, whatever the table's size
    by_length: dict[int, list] = {}
    for r in head:
        by_length.setdefault(len(r["v"]), []).append(r)
    seeds = spark.sparkContext.broadcast({d: (np.array([r["vec_id"] for r in rs], np.int64), np.array([r["v"] for r in rs], np.int64).reshape(len(rs), d)) for d, rs in by_length.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows into packed pieces: kind 0 for the shard that owns them, kind 1 (queries and their first k-th score) for every shard."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, off = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).offsets.to_numpy()
            size = np.diff(off)
            off = off - off[0]
            out = []
            for d in np.unique(size).tolist():
                pick = np.flatnonzero(size == d)
                points = flat[off[pick][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(pick), 0), np.int64)
                mine = ids[pick]
                own = (mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shards
                for s in np.unique(own).tolist():
                    out.append((s, d, 0, _pack(mine[own == s], points[own == s])))
                ask = np.flatnonzero(mine % every == 0)
                for a in range(0, len(ask), block):
                    q = ask[a : a + block]
                    floor = np.full(len(q), -np.inf)
                    if d in seeds.value:
                        sid, sv = seeds.value[d]
                        kind = _exact(sv, points[q])
                        scores = (points[q].astype(kind) @ sv.T.astype(kind)).astype(np.float64)
                        scores[mine[q][:, None] == sid[None, :]] = -np.inf
                        # repeated rows count once, so only distinct vec_ids may raise the floor
                        first = np.unique(sid, return_index=True)[1]
                        if len(first) >= k:
                            floor = np.partition(scores[:, first], len(first) - k, axis=1)[:, len(first) - k]
                    data = _pack(mine[q], points[q]) + floor.astype("<f8").tobytes()
                    out += [(s, d, 1, data) for s in range(shards)]
            s, d, kind, data = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(d, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["shard", "d", "kind", "data"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            out = ([], [], [])
            for s, d, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, d) != key:
                    key, held, tree = (s, d), [], None
                if kind == 0:
                    held.append(_unpack(data))
                    continue
                if not held:
                    continue
                n_q = int.from_bytes(data[:8], "little")
                ids, queries = _unpack(data)
                floor = np.frombuffer(data, "<f8", n_q, len(data) - 8 * n_q)
                if tree is None:
                    points = np.concatenate([p.astype(np.int64) for _, p in held])
                    row = np.column_stack([np.concatenate([i for i, _ in held]), points])
                    row = np.unique(row, axis=0)  # exact repeats count once
                    tree = Tree(row[:, 0].copy(), row[:, 1:].astype(_exact(points, points)))
                    held = held[:1]
                kind_ = _exact(tree.points, queries)
                if tree.points.dtype != kind_ and kind_ is np.int64:
                    tree.points, tree.low, tree.high = (x.astype(np.int64) for x in (tree.points, tree.low, tree.high))
                queries = queries.astype(tree.points.dtype)
                bounds = tree.bounds(queries)
                for i, own in enumerate(ids.tolist()):
                    for score, vec in tree.search(own, queries[i], bounds[i], k, floor[i]):
                        out[0].append(own)
                        out[1].append(-vec)
                        out[2].append(int(score))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    pieces = good.mapInArrow(deal, "shard int, d int, kind int, data binary")
    found = pieces.repartition(shards, "shard").sortWithinPartitions("shard", "d", "kind").mapInArrow(walk, "query_id long, vec_id long, score long").distinct()
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
