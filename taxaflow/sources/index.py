"""The index as a directory of Parquet tables (genomes, nodes, sequences) with meta as JSON lines; and what can be read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.sequence import base_name
from taxaflow.operators import search, taxonomy

TABLES = ("genomes", "nodes", "sequences")


def usable_genomes(genomes: DataFrame, conversion: DataFrame, up: DataFrame, within: int | None = None, ignore_uncategorised: bool = False, by_taxon: bool = False) -> DataFrame:
    """(seq, name, tax_id, bases): the first genome of each name, in file order, numbered; within one subtree if asked.

    genomes: file_no, read_no, id, seq. by_taxon names a taxon's sequences alike and puts them side by side.
    """
    first = genomes.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("file_no", "read_no"))).where("r = 1")
    rows = first.join(conversion.select(F.col("seq_id").alias("id"), "tax_id"), "id", "inner" if ignore_uncategorised else "left")
    if within is not None:
        rows = rows.join(up.where(F.col("anc") == within).select("tax_id"), "tax_id", "left_semi")
    order = ["file_no", "read_no"]
    rows = rows.withColumn("name", F.coalesce(F.col("tax_id").cast("string"), F.lit("uncategorized")) if by_taxon else F.col("id"))
    # numbers in two levels, so no task sorts all sequences: positions within a file, then files
    if by_taxon:
        return rows.select((F.dense_rank().over(W.orderBy(F.col("tax_id").asc_nulls_last())) - 1).cast("long").alias("seq"), "name", "tax_id", F.col("seq").alias("bases"), *order)
    sizes = rows.groupBy("file_no").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("file_no", F.coalesce(F.sum("m").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = F.row_number().over(W.partitionBy("file_no").orderBy("read_no")) - 1
    return rows.withColumn("at", at).join(before, "file_no").select((F.col("at") + F.col("base")).cast("long").alias("seq"), "name", "tax_id", F.col("seq").alias("bases"), *order)


def file_genomes(genomes: DataFrame, conversion: DataFrame, up: DataFrame, within: int | None = None, ignore_uncategorised: bool = False, width: int = search.WIDTH) -> DataFrame:
    """(seq, name, tax_id, bases, file_no, read_no): a genome is a file (file, file_no, read_no, seq) and named like it, its records are contigs that share a seq. conversion holds file names; contigs not longer than width are dropped."""
    rows = genomes.withColumn("id", base_name(F.col("file"))).join(conversion.select(F.col("seq_id").alias("id"), "tax_id"), "id", "inner" if ignore_uncategorised else "left")
    if within is not None:
        rows = rows.join(up.where(F.col("anc") == within).select("tax_id"), "tax_id", "left_semi")
    rows = rows.where(F.length(F.regexp_replace("seq", "[^ACGT]", "")) > width)
    names = rows.groupBy("id").agg(F.min(F.struct("file_no", "read_no")).alias("first"))
    numbers = names.select("id", (F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("no"))  # a row a file
    return rows.join(numbers, "id").select(F.col("no").alias("seq"), F.col("id").alias("name"), "tax_id", F.col("seq").alias("bases"), "file_no", "read_no")


def is_protein(index: dict[str, DataFrame]) -> bool:
    """Whether the index holds amino acids; without a word on it, it holds bases."""
    return not index["meta"].where("key = 'sequence_type' and value = 'amino_acid'").isEmpty()


def seq_names(index: dict[str, DataFrame]) -> DataFrame:
    return index["sequences"].select("name").distinct()


def index_size(index: dict[str, DataFrame]) -> DataFrame:
    """(part, value): letters of the text, sequences, nodes."""
    parts = [index["sequences"].agg(F.lit("letters").alias("part"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("value"))]
    parts += [index[t].agg(F.lit(t).alias("part"), F.count(F.lit(1)).alias("value")) for t in ("sequences", "nodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def build(genomes: DataFrame, nodes: DataFrame, path: str, width: int = search.WIDTH, protein: bool = False) -> None:
    """Writes the index of usable_genomes(). Nodes are pruned to the taxa present and their ancestors. protein: letters are amino acids."""
    order = [c for c in ("file_no", "read_no") if c in genomes.columns]
    kept = genomes.select("seq", "name", "tax_id", *order, F.regexp_replace("bases", f"[^{search.AMINO}]" if protein else "[^ACGT]", "").alias("bases")).where(F.length("bases") > width)
    spark = genomes.sparkSession
    up = taxonomy.closure(nodes)
    sequences = kept.groupBy("seq", "name", "tax_id").agg(F.sum(F.length("bases")).cast("long").alias("length"))
    kept.drop("name", "tax_id").write.mode("overwrite").parquet(f"{path}/genomes")
    taxonomy.prune(nodes, up, kept.where("tax_id is not null")).write.mode("overwrite").parquet(f"{path}/nodes")
    sequences.write.mode("overwrite").parquet(f"{path}/sequences")
    spark.createDataFrame([("width", str(width)), ("sequence_type", "amino_acid" if protein else "nucleotide")], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES} | {"meta": spark.read.schema("key string, value string").json(f"{path}/meta")}


def summary(index: dict[str, DataFrame]) -> DataFrame:
    """name, tax_id, length, scientific name of each sequence."""
    return index["sequences"].join(index["nodes"].select("tax_id", F.col("name").alias("taxon")), "tax_id", "left").select("name", "tax_id", "length", F.coalesce("taxon", F.lit("Unknown")).alias("taxon"))


def conversion_table(index: dict[str, DataFrame]) -> DataFrame:
    return index["sequences"].select(F.col("name").alias("seq_id"), "tax_id")


def size_table(index: dict[str, DataFrame]) -> DataFrame:
    """tax_id, length of every taxon with a size."""
    own = taxonomy.taxon_lengths(index["sequences"].where("tax_id is not null"))
    return taxonomy.infer_lengths(own, taxonomy.closure(index["nodes"])).where("length > 0")
