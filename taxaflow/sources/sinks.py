"""Writers: classification tables, reads split by outcome, and report layouts as lines of text."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.taxonomy import CANONICAL


def fixed(value: Column | str, digits: int) -> Column:
    """A number with so many digits; a tie goes to the even one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.bround(value.cast("decimal(38,15)"), digits).cast(f"decimal(38,{digits})").cast("string")


def write_classification(rows: DataFrame, path: str, sample: str | None = None) -> None:
    """Tab-separated with a header, gzip; a folder for each value of the column `sample`."""
    writer = rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip")
    (writer.partitionBy(sample) if sample else writer).csv(path)


def read_lines(reads: DataFrame) -> DataFrame:
    """Records of reads (id, seq, qual) as lines: FASTQ, or FASTA without qualities."""
    lines = F.when(F.col("qual").isNull(), F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).otherwise(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))
    return reads.select(lines.alias("value"))


def write_split_reads(reads: DataFrame, rows: DataFrame, classified: str | None, unclassified: str | None) -> None:
    """Reads that have a taxon, and those that have none, as gzip text."""
    known = rows.where("taxID <> 0").select(F.col("readID").alias("id")).distinct()
    for path, how in ((classified, "left_semi"), (unclassified, "left_anti")):
        if path:
            read_lines(reads.join(known, "id", how)).write.mode("overwrite").option("compression", "gzip").text(path)


def lineage_of(nodes: DataFrame, up: DataFrame, root: int) -> DataFrame:
    """tax_id, names, ids, prefixed: canonical ancestors and the taxon itself from the root down, joined by |."""
    rows = up.where(F.col("anc") != root).join(nodes.select(F.col("tax_id").alias("anc"), "rank", "name"), "anc").where(F.col("rank").isin(*CANONICAL))
    letter = F.when(F.col("rank").isin("superkingdom", "acellular root", "domain"), F.lit("d")).otherwise(F.substring("rank", 1, 1))
    steps = F.sort_array(F.collect_list(F.struct("depth", "anc", "name", F.concat(letter, F.lit("__"), "name").alias("prefixed"))), asc=False)

    def joined(field: str) -> F.Column:
        return F.array_join(F.transform("steps", lambda x: x[field].cast("string")), "|")

    return rows.groupBy("tax_id").agg(steps.alias("steps")).select("tax_id", joined("name").alias("names"), joined("anc").alias("ids"), joined("prefixed").alias("prefixed"))


def metaphlan(report: DataFrame, lineages: DataFrame) -> DataFrame:
    """Lines (clade, ids, abundance in percent, empty) of a quantification report's canonical taxa; the report holds those with reads, parts of one included."""
    rows = report.where(F.col("taxRank").isin(*CANONICAL)).join(lineages, report["taxID"] == lineages["tax_id"])
    return rows.select(F.concat_ws("\t", "prefixed", "ids", fixed(100 * F.col("abundance"), 5), F.lit("")).alias("value"))


def cami(report: DataFrame, lineages: DataFrame) -> DataFrame:
    """Lines (tax id, rank, id path, name path, percent)."""
    rows = report.where(F.col("taxRank").isin(*CANONICAL)).join(lineages, report["taxID"] == lineages["tax_id"])
    return rows.select(F.concat_ws("\t", F.col("taxID").cast("string"), "taxRank", "ids", "names", fixed(100 * F.col("abundance"), 5)).alias("value"))


def clade_tree(report: DataFrame, nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(path, tax_id, depth, name, rank, percent, clade_reads, own_reads, and score if the report has it): ordering by path walks the tree depth first, larger clades first. Unclassified reads (taxon 0) are before the tree."""
    counts = report.select(F.col("tax_id").alias("anc"), F.col("clade_reads").alias("c")).where("anc <> 0")
    steps = up.join(counts, "anc").groupBy("tax_id").agg(F.sort_array(F.collect_list(F.struct(F.col("depth"), (-F.col("c")).alias("c"), "anc")), asc=False).alias("s"))
    rows = report.where("tax_id <> 0").join(steps, "tax_id").join(nodes.select("tax_id", "name", "rank"), "tax_id")
    values = ["percent", "clade_reads", "own_reads", *(["score"] if "score" in report.columns else [])]
    tree = rows.select(F.transform("s", lambda x: F.struct(x["c"].alias("c"), x["anc"].alias("anc"))).alias("path"), "tax_id", (F.size("s") - 1).alias("depth"), "name", "rank", *values)
    path = F.array(F.struct(F.lit(float("-inf")).alias("c"), F.lit(0).cast("long").alias("anc")))
    none = report.where("tax_id = 0").select(path.alias("path"), "tax_id", F.lit(0).alias("depth"), F.lit("unclassified").alias("name"), F.lit("unclassified").alias("rank"), *values)
    return none.unionByName(tree)


def clade_lines(tree: DataFrame, unclassified: bool = False) -> DataFrame:
    """The tree as report lines in order: percent, clade reads, own reads, rank letter, id, indented name, score if there is one. unclassified = True: that line comes first even if no read is."""
    if unclassified:
        line = {"tax_id": F.lit(0), "depth": F.lit(0), "name": F.lit("unclassified"), "rank": F.lit("unclassified")}
        types = dict(tree.dtypes)
        path = F.array(F.struct(F.lit(float("-inf")).alias("c"), F.lit(0).cast("long").alias("anc")))
        none = tree.sparkSession.range(1).select(*[path.alias(c) if c == "path" else line.get(c, F.lit(0)).cast(types[c]).alias(c) for c in tree.columns])
        tree = tree.unionByName(none.join(tree.where("tax_id = 0").select("tax_id"), "tax_id", "left_anti"))
    letter = F.when(F.col("rank").isin("species", "genus", "family", "order", "class", "phylum", "kingdom"), F.upper(F.substring("rank", 1, 1))).when(F.col("rank").isin("superkingdom", "domain", "acellular root"), F.lit("D")).when(F.col("tax_id") == 0, F.lit("U")).otherwise(F.lit("-"))
    score = [F.col("score").cast("string")] if "score" in tree.columns else []
    return tree.orderBy("path").select(F.concat_ws("\t", F.format_string("%6s", fixed("percent", 2)), fixed("clade_reads", 0), fixed("own_reads", 0), letter, F.col("tax_id").cast("string"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name"), *score).alias("value"))


def native_tree(counts: DataFrame, nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(path, tax_id, depth, code, name, reads, own, abundance) of a quantification's taxa with reads; counts: tax_id, reads (of the clade), abundance. Ordering by path walks depth first, children by id.

    code: the rank's letter, D for the highest ranks, R for the root; for other taxa the letter of the nearest ranked
    ancestor and the steps to it. Strains have no letter of their own, and below an unranked root it is R.
    """
    kept = counts.where("reads >= 1e-6").join(nodes, "tax_id")
    plain = F.col("rank").isin(*[r for r in CANONICAL if r != "strain"])
    letter = F.when(F.col("rank").isin("superkingdom", "acellular root"), F.lit("D")).when(plain, F.upper(F.substring("rank", 1, 1))).when(F.col("tax_id") == F.col("parent_id"), F.lit("R"))
    steps = up.join(nodes.select(F.col("tax_id").alias("anc"), letter.alias("letter")), "anc").groupBy("tax_id").agg(F.sort_array(F.collect_list(F.struct("depth", "anc")), asc=False).alias("steps"), F.min(F.when(F.col("letter").isNotNull(), F.struct("depth", "letter"))).alias("near"))
    below = kept.where("tax_id <> parent_id").groupBy(F.col("parent_id").alias("tax_id")).agg(F.sum("reads").alias("below"))
    rows = kept.join(steps, "tax_id").join(below, "tax_id", "left")
    code = F.concat("near.letter", F.when(F.col("near.depth") > 0, F.col("near.depth").cast("string")).otherwise(F.lit("")))
    return rows.select(F.transform("steps", lambda x: x["anc"]).alias("path"), "tax_id", (F.size("steps") - 1).alias("depth"), code.alias("code"), "name", "reads", (F.col("reads") - F.coalesce("below", F.lit(0.0))).alias("own"), "abundance")


def native_lines(tree: DataFrame) -> DataFrame:
    """native_tree() as lines in order: percent, clade reads, own reads, code, id, indented name."""
    return tree.orderBy("path").select(F.concat_ws("\t", fixed(100 * F.col("abundance"), 2), fixed("reads", 0), fixed("own", 0), "code", F.col("tax_id").cast("string"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name")).alias("value"))


# Header lines of report formats.
HEADERS = {"default": "name\ttaxID\ttaxRank\tgenomeSize\tnumReads\tnumUniqueReads\tabundance", "metaphlan": "#clade_name\tNCBI_tax_id\trelative_abundance\tadditional_species", "cami": "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"}


def report_lines(report: DataFrame, nodes: DataFrame, up: DataFrame, root: int, form: str = "default") -> DataFrame:
    """(value, header first) of a quantification report in the format default, metaphlan, cami or kreport; an unknown one warns and gives the default."""
    if form == "kreport":
        return native_lines(native_tree(report.select(F.col("taxID").alias("tax_id"), F.col("reads"), "abundance"), nodes, up))
    if form not in HEADERS:
        warnings.warn(f"unknown report format {form}; the default is written", stacklevel=2)
        form = "default"
    if form == "default":
        lines = report.select(F.col("taxID").alias("at"), F.concat_ws("\t", "name", F.col("taxID").cast("string"), "taxRank", *[F.col(c).cast("string") for c in ("genomeSize", "numReads", "numUniqueReads")], F.format_string("%g", "abundance")).alias("value"))
    else:
        lines = (metaphlan if form == "metaphlan" else cami)(report, lineage_of(nodes, up, root)).select(F.lit(0).cast("long").alias("at"), "value")
    head = report.sparkSession.range(1).select(F.lit(None).cast("long").alias("at"), F.lit(HEADERS[form]).alias("value"))
    return head.unionByName(lines).orderBy(F.col("at").asc_nulls_first(), F.col("value")).select("value")


def processed_line(rows: DataFrame) -> DataFrame:
    """One row: processed and classified reads of a classification table, their percentage, and the line a log shows."""
    reads = rows.groupBy("readID").agg(F.max((F.col("taxID") != 0).cast("long")).alias("c"))
    totals = reads.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum("c"), F.lit(0)).alias("classified"))
    percent = F.when(F.col("processed") > 0, 100 * F.col("classified") / F.col("processed")).otherwise(F.lit(0.0))
    return totals.withColumn("percent", F.round(percent, 6)).withColumn("value", F.format_string("Processed %d read fragments, and %d (%s%%) can be classified.", "processed", "classified", fixed(percent, 2)))


def write_split_mates(reads: DataFrame, rows: DataFrame, prefix: str, classified: bool) -> None:
    """Reads (id, seq, qual and, where there are mates or tags, seq2, qual2, barcode, umi) of one outcome: prefix_1 and prefix_2 with mates, else prefix; prefix_bc and prefix_um hold tags as FASTA."""
    known = rows.where("taxID <> 0").select(F.col("readID").alias("id")).distinct()
    kept = reads.join(known, "id", "left_semi" if classified else "left_anti")
    mates, none = "seq2" in reads.columns, F.lit(None).cast("string").alias("qual")
    parts = {"_1" if mates else "": kept.select("id", "seq", "qual")}
    if mates:
        parts["_2"] = kept.where("seq2 is not null").select("id", F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))
    parts |= {suffix: kept.select("id", F.col(tag).alias("seq"), none) for suffix, tag in (("_bc", "barcode"), ("_um", "umi")) if tag in reads.columns}
    for suffix, part in parts.items():
        read_lines(part).write.mode("overwrite").option("compression", "gzip").text(prefix + suffix)
