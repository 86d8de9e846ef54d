"""Readers of taxonomy dumps, sequence files and result tables. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nodes_dmp(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, parent_id, rank; of repeated ids the first line counts."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("not startswith(value, '#')")
    p = F.split("value", r"\t?\|\t?")
    rows = lines.select(p[0].cast("long").alias("tax_id"), p[1].cast("long").alias("parent_id"), F.trim(p[2]).alias("rank"), "at")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("tax_id").orderBy("at"))).where("r = 1").drop("r", "at")


def names_dmp(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, name of scientific names, words joined by _."""
    p = F.split("value", r"\t?\|\t?")
    return spark.read.text(path).where(F.col("value").contains("scientific name")).select(p[0].cast("long").alias("tax_id"), F.regexp_replace(F.trim(p[1]), r"\s+", "_").alias("name"))


def pairs(spark: SparkSession, path: str, first: str, second: str, kind: str = "long") -> DataFrame:
    """Two white-space columns: conversion tables (seq_id, tax_id), size tables (tax_id, length), count tables."""
    p = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias(first), p[1].cast(kind).alias(second))


CLASSIFICATION = "readID string, seqID string, taxID long, score long, 2ndBestScore long, hitLength int, queryLength int, numMatches int"


def classification_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The rows with a row_no that keeps their order."""
    return spark.read.csv(path, sep="\t", header=True, schema=CLASSIFICATION).withColumn("row_no", F.monotonically_increasing_id())


def parse_fastx(data: bytes) -> Iterator[tuple[str, str, str, str | None]]:
    """(id, comment, seq, qual) of FASTA or FASTQ text, multi-line records included; a broken record ends the file."""
    lines = data.decode("latin-1").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        if not line or line[0] not in ">@":
            continue
        name, *rest = re.split(r"\s", line[1:], maxsplit=1)
        comment = rest[0] if rest else ""
        seq = []
        while i < len(lines) and lines[i][:1] not in (">", "@", "+"):
            seq.append(lines[i].strip())
            i += 1
        s = "".join(seq)
        if i < len(lines) and lines[i][:1] == "+":
            i += 1
            qual = ""
            while i < len(lines) and len(qual) < len(s):
                qual += lines[i].rstrip("\r")
                i += 1
            if len(qual) != len(s):
                return
            yield name, comment, s, qual
        else:
            yield name, comment, s, None


def fastx(spark: SparkSession, path: str) -> DataFrame:
    """file_no, file, read_no, id (mate suffix taken off), comment, seq, qual of plain or gzip files; files are numbered in the order of their paths."""
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows: list[tuple] = []
                for k, (name, comment, seq, qual) in enumerate(parse_fastx(data)):
                    rows.append((file, k, name[:-2] if name[-2:] in ("/1", "/2") else name, comment, seq, qual))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    found = spark.read.format("binaryFile").load(path)
    numbers = found.select(F.col("path").alias("file"), (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("file_no"))  # a row a file
    reads = found.select("path", "content").mapInArrow(run, "file string, read_no long, id string, comment string, seq string, qual string")
    return reads.join(F.broadcast(numbers), "file").select("file_no", "file", "read_no", "id", "comment", "seq", "qual")


def size_table(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, length; of repeated taxa the last line counts."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(p[0].cast("long").alias("tax_id"), p[1].cast("long").alias("length"), "at").groupBy("tax_id").agg(F.max_by("length", "at").alias("length"))


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, count, row_no."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].cast("long").alias("tax_id"), p[1].cast("double").alias("count"), F.monotonically_increasing_id().alias("row_no"))


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """sample_no, read1, read2, barcode, umi, output; a dot is none."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    fields = [F.nullif(F.get(p, F.lit(i)), F.lit(".")).alias(c) for i, c in enumerate(("read1", "read2", "barcode", "umi", "output"))]
    return lines.select((F.row_number().over(W.orderBy("at")) - 1).cast("long").alias("sample_no"), *fields)  # a row a sample


def genome_list(spark: SparkSession, path: str) -> DataFrame:
    """file_no, path, tax_id (null where the line names no taxon)."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    return lines.select((F.row_number().over(W.orderBy("at")) - 1).cast("long").alias("file_no"), p[0].alias("path"), F.get(p, F.lit(1)).cast("long").alias("tax_id"))  # a row a file


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "read_no", "id", "comment", "seq", "qual"])
