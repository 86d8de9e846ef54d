"""Token counts by a separator scan over flat token files.

A token file is a run of token ids with an end-of-document id after each document and no index. store() lays documents
out so: one file a partition of the scan, cut into blocks of `block` tokens wherever that falls. scan() knows only
(file, block_no, tokens): a vectorised search finds the separators of each block, and a block becomes a few numbers: how
many separators, tokens before the first and after the last. An exclusive prefix scan over a file's blocks (number of
separators so far, tokens open since the last) stitches documents that cross blocks. Tokens never leave the task that
searched them; only the numbers move.

Null text is an empty document (0 tokens). Tokens after a file's last separator belong to no document and are reported
only by scan(tail=True). Repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.llm.byte_bpe import bpe_of
from taxaflow.llm.common import ensure_checkpoint_dir, slices

BLOCKS = "file long, block_no long, tokens binary, doc_ids array<long>, first_doc long"


def store(docs: DataFrame, ranks: bytes, separator: int, block: int = 1 << 16) -> DataFrame:
    """(file, block_no, tokens as little-endian u16 or u32), and beside the tokens which documents ended in the block's writing (doc_ids, first_doc: for naming results only)."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = "<u2" if separator < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, bpe = TaskContext.get().partitionId(), bpe_of(shipped.value)
        number, written, held, size, ids = 0, 0, [], 0, []
        end = np.array([separator], kind)

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, written, held, size, ids
            flat = np.concatenate(held) if held else end[:0]
            cut = len(flat) if final else len(flat) - len(flat) % block
            if not cut:
                return
            pieces = [flat[a : min(cut, a + block)].tobytes() for a in range(0, cut, block)]
            names = [ids, *[[] for _ in pieces[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(pieces), pa.int64()), pa.array(range(number, number + len(pieces)), pa.int64()), pa.array(pieces, pa.binary()), pa.array(names, pa.list_(pa.int64())), pa.array([written] * len(pieces), pa.int64())], names=["file", "block_no", "tokens", "doc_ids", "first_doc"])
            number, written, held, size, ids = number + len(pieces), written + len(ids), [flat[cut:]], len(flat) - cut, []

        for batch in slices(batches, "text", 2 << 20):
            for doc, (coded, _) in zip(batch.column(0).to_pylist(), bpe.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                held += [np.frombuffer(coded, "<u4").astype(kind), end]
                size += len(coded) // 4 + 1
                ids.append(doc)
            if size >= block:
                yield from rows(False)
        yield from rows(True)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, separator: int, tail: bool = False) -> DataFrame:
    """(file, doc_no, n_tokens) of every document in files of (file, block_no, tokens)."""
    kind = "<u2" if separator < 1 << 16 else "<u4"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, b, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = np.frombuffer(data, kind)
                at = np.flatnonzero(tokens == separator)
                inner = (np.diff(at) - 1).tolist()
                out.append((f, b, len(at), int(at[0]) if len(at) else len(tokens), len(tokens) - int(at[-1]) - 1 if len(at) else len(tokens), inner))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], names=["file", "block_no", "n", "head", "tail", "inner"])

    found = blocks.select("file", "block_no", "tokens").mapInArrow(search, "file long, block_no long, n long, head long, tail long, inner array<long>")
    before = W.partitionBy("file").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    # open tokens: since the last block with a separator, its tail and the whole blocks after it
    whole = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("tail")).otherwise(0)).over(before), F.lit(0))
    found = found.withColumns({"seen": F.coalesce(F.sum("n").over(before), F.lit(0)), "whole": whole})
    last = F.last(F.when(F.col("n") > 0, F.struct("tail", "whole")), ignorenulls=True).over(before)
    found = found.withColumn("open", F.when(last.isNull(), F.col("whole")).otherwise(last["tail"] + F.col("whole") - last["whole"]))
    counts = F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))
    docs = found.where("n > 0").select("file", "seen", F.posexplode(counts).alias("i", "n_tokens")).select("file", (F.col("seen") + F.col("i")).alias("doc_no"), "n_tokens")
    if tail:
        ends = found.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy(F.desc("block_no")))).where("r = 1")
        left = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
        docs = docs.unionByName(ends.select("file", F.lit(None).cast("long").alias("doc_no"), left.alias("n_tokens")).where("n_tokens > 0"))
    return docs


def count_tokens(docs: DataFrame, ranks: bytes, separator: int = 50256, block: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens of every document: stored as flat token files in the checkpoint folder, then scanned."""
    ensure_checkpoint_dir(docs.sparkSession)
    stored = store(docs, ranks, separator, block).checkpoint()
    names = stored.where(F.size("doc_ids") > 0).select("file", F.posexplode("doc_ids").alias("i", "doc_id"), "first_doc").select("file", (F.col("first_doc") + F.col("i")).alias("doc_no"), "doc_id")
    return scan(stored, separator).join(names, ["file", "doc_no"]).select("doc_id", "n_tokens")
