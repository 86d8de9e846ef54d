"""Transforms that prepare databases: assembly lists, accession maps and lineage strings turned into trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.operators import taxonomy as T

NEW_ID = 10_000_000


def choose_assemblies(lines: DataFrame, level: str | None = None, category: str | None = None, taxids: list[int] | None = None) -> DataFrame:
    """(taxid, species_taxid, path) of the latest assemblies in an assembly summary's lines (value), by regular expressions on level and category."""
    c = F.split("value", "\t")
    rows = lines.where("not startswith(value, '#')").select(c[4].alias("category"), c[5].cast("long").alias("taxid"), c[6].cast("long").alias("species_taxid"), c[10].alias("version"), c[11].alias("level"), F.array(F.get(c, F.lit(19)), F.get(c, F.lit(20))).alias("paths")).where("version = 'latest'")
    if level:
        rows = rows.where(F.col("level").rlike(level))
    if category:
        rows = rows.where(F.col("category").rlike(category))
    if taxids:
        rows = rows.where(F.col("taxid").isin(taxids) | F.col("species_taxid").isin(taxids))
    return rows.select("taxid", "species_taxid", F.explode("paths").alias("path")).where("path like '%ftp%'")


def sequence_file(path: F.Column, suffix: str = "_genomic.fna.gz") -> F.Column:
    return F.concat(path, F.lit("/"), F.regexp_extract(path, "([^/]+)/?$", 1), F.lit(suffix))


def embl_to_fasta(lines: DataFrame) -> DataFrame:
    """(record, header, seq) of EMBL lines (file, line_no, value): DE lines make the header, indented lines the sequence."""
    w = W.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("record", F.coalesce(F.sum(F.col("value").startswith("//").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.where("value like 'DE %' or value like '     %'").withColumn("is_seq", ~F.col("value").startswith("DE"))

    def text(seq: bool, by: str) -> F.Column:
        part = F.when(F.col("is_seq") == seq, F.struct("line_no", "value"))
        return F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: F.upper(F.regexp_replace(x["value"], "[0-9 ]", "")) if seq else F.trim(F.substring(x["value"], 3, 1_000_000))), by)

    return kept.groupBy("file", "record").agg(text(False, " ").alias("header"), text(True, "").alias("seq"))


def taxids_of(accessions: DataFrame, table: DataFrame) -> DataFrame:
    """accession, taxid: looked up without the version; 1 where the table (accession, taxid) has none."""
    return accessions.withColumn("base", F.substring_index("accession", ".", 1)).join(table.select(F.col("accession").alias("base"), "taxid"), "base", "left").select("accession", F.coalesce("taxid", F.lit(1)).cast("long").alias("taxid"))


def known_accessions(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table (version, taxid) whose versioned accession is among ids (id)."""
    return table.join(ids.select(F.col("id").alias("version")), "version", "left_semi").select("version", "taxid")


def genome_path(accession: F.Column) -> F.Column:
    """GCF/000/657/795/<accession>_genomic.fna.gz of an accession with a three-letter prefix before it, such as RS_GCF_000657795.2."""
    a = F.substring(accession, 4, 1000)
    return F.concat_ws("/", F.substring(a, 1, 3), F.substring(a, 5, 3), F.substring(a, 8, 3), F.substring(a, 11, 3), F.concat(a, F.lit("_genomic.fna.gz")))


# Ranks by lineage prefix.
PREFIX = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}


def tree_from_lineages(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tax_id, parent_id, rank, name, prefixed) of lineages such as d__A;p__B;... in rows (row_no, lineage).

    A name has the id of the table known (name, tax_id), else the next one from 10,000,000 on in the order first seen. One
    name under two parents fails the query. A global numbering needs one order over distinct names, not over rows.
    """
    steps = rows.select("row_no", F.posexplode(F.split("lineage", ";")).alias("at", "prefixed"), F.split("lineage", ";").alias("all"))
    steps = steps.withColumn("above", F.when(F.col("at") > 0, F.get("all", F.col("at") - 1)).otherwise(F.lit("")))
    names = steps.groupBy("prefixed").agg(F.min(F.struct("row_no", "at")).alias("seen"), F.min("above").alias("above"), F.max("above").alias("above2"))
    names = names.withColumn("above", F.when(F.col("above") == F.col("above2"), F.col("above")).otherwise(F.raise_error(F.concat(F.lit("two parents of "), F.col("prefixed"))).cast("string"))).drop("above2").withColumn("name", F.expr("substring(prefixed, 4)"))
    if known is not None:
        names = names.join(known.groupBy("name").agg(F.min("tax_id").alias("given")), "name", "left")
    else:
        names = names.withColumn("given", F.lit(None).cast("long"))
    fresh = names.where("given is null").select("prefixed", (NEW_ID - 1 + F.row_number().over(W.orderBy("seen"))).cast("long").alias("new"))
    ids = names.join(fresh, "prefixed", "left").select("prefixed", "above", "name", F.coalesce("given", "new").alias("tax_id"))
    rank = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    parents = ids.select(F.col("prefixed").alias("above"), F.col("tax_id").alias("parent"))
    return ids.join(parents, "above", "left").select("tax_id", F.coalesce("parent", F.lit(1)).cast("long").alias("parent_id"), F.coalesce(F.try_element_at(rank, F.substring("prefixed", 1, 1)), F.lit("no rank")).alias("rank"), "name", "prefixed")


def tree_from_paths(rows: DataFrame) -> DataFrame:
    """(tax_id, parent_id, rank, name) of paths A;B;C; in rows (row_no, path, tax_id, rank): the parent is the row whose own name is the path's name before last; of equal names the last row counts; 1 without one."""
    parts = F.filter(F.split("path", ";"), lambda x: x != "")
    own = rows.withColumn("parts", parts).select("row_no", "tax_id", "rank", F.element_at("parts", -1).alias("name"), F.get("parts", F.size("parts") - 2).alias("above"))
    last = own.groupBy(F.col("name").alias("above")).agg(F.max_by("tax_id", "row_no").alias("parent"))
    return own.join(last, "above", "left").select("tax_id", F.coalesce("parent", F.lit(1)).cast("long").alias("parent_id"), "rank", "name")


def promote_ids(ids: DataFrame, nodes: DataFrame, up: DataFrame, rank: str) -> DataFrame:
    """tax_id, promoted: the nearest ancestor of a rank, null without one."""
    at = up.join(nodes.where(F.col("rank") == rank).select(F.col("tax_id").alias("anc")), "anc").groupBy("tax_id").agg(F.min_by("anc", "depth").alias("promoted"))
    return ids.select("tax_id").join(at, "tax_id", "left")


def merge_seq_taxa(rows: DataFrame, up: DataFrame, root: int) -> DataFrame:
    """(seq_id, tax_id): a sequence named with several taxa has their lowest common ancestor."""
    return T.lca(rows.select("seq_id", "tax_id"), up, root, "seq_id").select("seq_id", F.col("lca").alias("tax_id"))


def header_map(reads: DataFrame, tax_id: int) -> DataFrame:
    """(seq_id, tax_id) of the records of one taxon's files."""
    return reads.select(F.col("id").alias("seq_id"), F.lit(tax_id).cast("long").alias("tax_id"))


def file_map(reads: DataFrame, tax_id: int) -> DataFrame:
    """(file, tax_id) of one taxon's files."""
    return reads.select("file").distinct().withColumn("tax_id", F.lit(tax_id).cast("long"))


def file_header_map(reads: DataFrame, files: DataFrame) -> DataFrame:
    """(seq_id, tax_id) of records (file_no, read_no, id, file) whose files have taxa (file, tax_id): of an id in several files the last one counts; null where its file has no taxon."""
    last = reads.groupBy(F.col("id").alias("seq_id")).agg(F.max_by("file", F.struct("file_no", "read_no")).alias("file"))
    return last.join(files.select("file", "tax_id"), "file", "left").select("seq_id", "tax_id")


def dna(seq: F.Column) -> F.Column:
    """RNA letters as DNA."""
    return F.translate(seq, "Uu", "Tt")
