"""Reads before classification: mates put together, barcodes corrected and translated. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_KEYS = ["file_no", "read_no"]


def zip_records(**sides: DataFrame) -> DataFrame:
    """One row for each (file_no, read_no) with a struct for each side; a side with fewer or more records fails the query."""
    (name, out), *rest = ((k, d.select(*_KEYS, F.struct(*[c for c in d.columns if c not in _KEYS]).alias(k))) for k, d in sides.items())
    for other, d in rest:
        out = out.join(d, _KEYS, "full")
        wrong = F.col(name).isNull() | F.col(other).isNull()
        whole = F.when(~wrong, F.col(other)).otherwise(F.raise_error(F.lit(f"{name} and {other} have different numbers of records")).cast(d.schema[other].dataType))
        out = out.withColumn(other, whole)
    return out


def split_interleaved(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first mates, second mates) of records that alternate; each pair gets one read_no."""
    both = reads.withColumn("second", F.col("read_no") % 2 == 1).withColumn("read_no", F.expr("read_no div 2"))
    return both.where("not second").drop("second"), both.where("second").drop("second")


def tagged(reads: DataFrame, segments: dict, tags: DataFrame | None = None, tag: str = "barcode", part: str = "bc") -> DataFrame:
    """reads with a column of raw tags, or unchanged if neither a tag file nor the format names any: from the records of a tag file (file_no, read_no, seq), else from the first read as it was before its own segments are cut."""
    if tags is not None:
        found = tags.select(*_KEYS, F.struct(F.col("seq").alias(tag)).alias("t"))
        return zip_records(r=reads, t=found.select(*_KEYS, f"t.{tag}")).select(*_KEYS, "r.*", f"t.{tag}")
    return reads.withColumn(tag, F.col("seq")) if segments.get(part) else reads


def barcode_counts(whitelist: DataFrame, barcodes: DataFrame, first: int | None = 2_000_000) -> DataFrame:
    """(barcode, n): one, and the exact matches among the first records in file order; None counts all."""
    seen = barcodes.select("file_no", "read_no", "barcode")
    if first is not None:
        seen = seen.orderBy("file_no", "read_no").limit(first)
    return whitelist.select("barcode").distinct().join(seen.groupBy("barcode").agg(F.count(F.lit(1)).alias("m")), "barcode", "left").select("barcode", (1 + F.coalesce("m", F.lit(0))).alias("n"))


def correct_barcodes(barcodes: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with a column `corrected`: the barcode if it is listed, else the listed one that differs in one base, of the highest count, then of the lowest quality there, then leftmost; N where there is none.

    Distinct (barcode, qual) are corrected once; a row has at most four neighbours for each base. barcodes: barcode, qual.
    """
    one = barcodes.select("barcode", "qual").where("barcode is not null").distinct()
    known = counts.select("barcode", F.lit(True).alias("listed"))
    open_ = one.join(known, "barcode", "left_anti")
    at = F.explode(F.sequence(F.lit(1), F.length("barcode")))
    near = open_.where("length(barcode) > 0").withColumn("at", at).withColumn("base", F.explode(F.array(*map(F.lit, "ACGT"))))
    near = near.withColumn("to", F.concat(F.expr("substring(barcode, 1, at - 1)"), "base", F.expr("substring(barcode, at + 1)")))
    found = near.join(counts.withColumnRenamed("barcode", "to"), "to")
    order = F.struct(-F.col("n"), F.coalesce(F.ascii(F.expr("substring(qual, at, 1)")), F.lit(0)), "at", "base")
    best = found.groupBy("barcode", "qual").agg(F.min_by("to", order).alias("fixed"))
    named = one.join(known, "barcode", "left").join(best.select(F.col("barcode").alias("b"), F.col("qual").alias("q"), "fixed"), (F.col("barcode") == F.col("b")) & F.col("qual").eqNullSafe(F.col("q")), "left")
    named = named.select(F.col("barcode").alias("b"), F.col("qual").alias("q"), F.when(F.col("listed"), F.col("barcode")).otherwise(F.coalesce("fixed", F.lit("N"))).alias("corrected"))
    return barcodes.join(named, (barcodes["barcode"] == F.col("b")) & barcodes["qual"].eqNullSafe(F.col("q")), "left").drop("b", "q").withColumn("corrected", F.coalesce("corrected", F.lit("N")))


def translate_barcode(barcode: Column, table: dict[str, str]) -> Column:
    """Pieces as long as the table's keys, each translated, joined by -; what is left over is dropped; an unknown piece fails the query."""
    width = len(list(table)[-1])
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    n = F.floor(F.length(barcode) / width).cast("int")
    pieces = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(barcode, i * width + 1, F.lit(width)))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(names, p), F.raise_error(F.concat(F.lit("no translation of "), p)).cast("string"))), "-")
