"""More registered queries over the driver's tables: classification from hits, counts, reports, maps and readers' rules, and the SQL that repeats them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions import sequence as S
from taxaflow.operators import classify as C
from taxaflow.operators import prepare as P
from taxaflow.operators import reads as B
from taxaflow.operators import results as R
from taxaflow.operators import search as X
from taxaflow.operators import taxonomy as T
from taxaflow.plans.queries import BASES, LETTERS, NODES, ROOT, SUPPLIER, _barcode, _dna, _table, _targets, nodes
from taxaflow.sources import index, sinks


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line of an order: a read's targets. Some lines, and all lines of some orders, are unclassified; one line in seven orders has a taxon outside the tree."""
    one = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("long").alias("score"), F.max("l_quantity").cast("int").alias("hitLength"), F.min("l_suppkey").alias("supp"), F.max(F.floor(F.col("l_tax") * 1_000_000)).alias("2ndBestScore"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    tax = F.when((order % 50 == 3) | ((order % 50 == 4) & (line == 2)), F.lit(0)).when((order % 7 == 2) & (line == 1), F.lit(5)).otherwise(F.col("supp") + SUPPLIER)
    return one.select(order.alias("readID"), tax.cast("long").alias("taxID"), "score", "2ndBestScore", "hitLength", F.lit(50).alias("queryLength"), line.cast("long").alias("row_no"))


ITEMS = f"""{NODES}, items AS (
  SELECT l_orderkey AS read, CASE WHEN l_orderkey % 50 = 3 OR l_orderkey % 50 = 4 AND l_linenumber = 2 THEN 0 WHEN l_orderkey % 7 = 2 AND l_linenumber = 1 THEN 5 ELSE min(l_suppkey) + {SUPPLIER} END AS tax,
    CAST(floor(max(l_extendedprice)) AS BIGINT) AS score, max(floor(l_tax * 1000000)) AS second, CAST(max(l_quantity) AS INTEGER) AS len, l_linenumber AS no FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
# the lowest common ancestors of t (read, tax)
ABOVE = f"""c AS (SELECT read, anc, count(*) AS c FROM t JOIN up ON tax = tax_id WHERE anc <> {ROOT} GROUP BY ALL), many AS (SELECT read, count(*) FILTER (WHERE tax <> {ROOT}) AS m FROM t GROUP BY ALL), height AS (SELECT tax_id, max(depth) AS h FROM up GROUP BY ALL),
lca AS (SELECT many.read, COALESCE(max_by(f.anc, f.h), {ROOT}) AS lca FROM many LEFT JOIN (SELECT c.read, c.c, anc, h FROM c JOIN height ON anc = tax_id) f ON f.read = many.read AND f.c = many.m GROUP BY ALL)"""


def read_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = R.read_counts(R.assignments(_items(spark, d)), n, T.closure(n), ROOT)
    return out.select("tax_id", F.round("reads", 6).alias("reads"), "uniq")


def classified_share(spark: SparkSession, d: str) -> DataFrame:
    return sinks.processed_line(_items(spark, d)).select("processed", "classified", "percent")


def clade_report_scores(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = R.clade_report(_items(spark, d), n, T.closure(n), ROOT, zeros=True, scores=True, least_score=5000, least_length=5)
    return out.select("tax_id", "clade_reads", "own_reads", F.round("percent", 6).alias("percent"), "score")


def clade_report_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows counted by their numMatches, which need not be the number of rows a read has here."""
    n = nodes(spark, d)
    rows = _items(spark, d).withColumn("numMatches", F.col("row_no").cast("int"))
    return R.clade_report(rows, n, T.closure(n), ROOT, with_lca=False).select("tax_id", F.round("clade_reads", 6).alias("clade_reads"), F.round("own_reads", 6).alias("own_reads"))


def clade_report_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    key = F.col("o_orderkey")
    tax = F.when(key % 100 == 0, F.lit(0)).when(key % 100 == 1, F.lit(5)).otherwise(100 + key % 25).cast("long")
    counts = _table(spark, d, "orders").select(tax.alias("tax_id"), (key % 37).cast("double").alias("count"), key.alias("row_no"))
    out = R.clade_report_of_counts(counts, n, T.closure(n), ROOT, zeros=True)
    return out.select("tax_id", "clade_reads", "own_reads", F.round("percent", 6).alias("percent"))


def clade_walk(spark: SparkSession, d: str) -> DataFrame:
    """Clades with the path that orders a depth-first walk."""
    n = nodes(spark, d)
    up = T.closure(n)
    tree = sinks.clade_tree(R.clade_report(_items(spark, d), n, up, ROOT), n, up).where("tax_id <> 0")
    return tree.select(F.array_join(F.transform("path", lambda x: F.concat_ws(":", (-x["c"]).cast("long").cast("string"), x["anc"].cast("string"))), "|").alias("path"), "tax_id", "depth", "name", "rank")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    no, size = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    items = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"))
    return items.select(F.col("l_orderkey").alias("read"), F.lit(1).alias("mate"), F.when(no % 3 == 0, -1).otherwise(1).alias("strand"), no.alias("hit"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 9 + no % 2).otherwise(F.col("l_suppkey")).cast("long").alias("seq"), (no * 31).cast("int").alias("offset"), F.when(size < 35, 30).otherwise(40).alias("length"), F.lit(1).cast("long").alias("occurrences"))


def classified_hits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reads, lines as hits on suppliers; each eleventh supplier has no taxon."""
    n = nodes(spark, d)
    seqs = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 11 != 0, F.col("s_suppkey") + SUPPLIER).alias("tax_id"))
    reads = _table(spark, d, "orders").select(F.col("o_orderkey").alias("read"), F.col("o_orderkey").cast("string").alias("id"), F.lit(100).alias("query_length"))
    return C.classify(reads, _hits(spark, d).where("seq > 0"), seqs, n, T.closure(n), ROOT)


def expanded_lca(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.expanded_taxa(_targets(spark, d), n, T.closure(n), ROOT, 1)


def expanded_3(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.expanded_taxa(_targets(spark, d), n, T.closure(n), ROOT, 3)


def general_tree(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumn("parent_id", F.when(F.col("rank") == "superkingdom", F.col("tax_id")).otherwise(F.col("parent_id")))
    return T.closure(T.general_tree(n, ROOT))


def named_targets(spark: SparkSession, d: str) -> DataFrame:
    return T.named_taxa(_targets(spark, d).select("tax_id").distinct(), nodes(spark, d), ROOT).select("tax_id", "known_id", "name", "rank")


def present_tree(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.prune(n, T.closure(n), _table(spark, d, "supplier").where("s_acctbal > 5000").select((F.col("s_suppkey") + SUPPLIER).alias("tax_id"))).select("tax_id", "parent_id")


def merged_seq_taxa(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return P.merge_seq_taxa(_table(spark, d, "lineitem").select(F.col("l_partkey").alias("seq_id"), (F.col("l_suppkey") + SUPPLIER).alias("tax_id")), T.closure(n), ROOT)


def promoted_ids(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return P.promote_ids(n, n, T.closure(n), "family")


def _clade_counts(spark: SparkSession, d: str, n: DataFrame, up: DataFrame) -> DataFrame:
    known = R.read_counts(R.assignments(_items(spark, d)), n, up, ROOT)
    return known.select("tax_id", F.round("reads", 6).alias("reads"), (F.round("reads", 6) / 100_000).alias("abundance"))


def native_report(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    up = T.closure(n)
    out = sinks.native_tree(_clade_counts(spark, d, n, up), n, up)
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "|").alias("path"), "tax_id", "depth", "code", "name", F.round("reads", 3).alias("reads"), F.round("own", 3).alias("own"))


def _layout(spark: SparkSession, d: str, layout) -> DataFrame:
    n = nodes(spark, d)
    up = T.closure(n)
    report = _table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("taxID"), F.lit("species").alias("taxRank"), (F.col("s_suppkey") / 4096).alias("abundance"))
    return layout(report, sinks.lineage_of(n, up, ROOT))


def metaphlan_lines(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d, sinks.metaphlan)


def cami_lines(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d, sinks.cami)


def document_frames(spark: SparkSession, d: str) -> DataFrame:
    """Six-frame translations of all documents."""
    return _table(spark, d, "documents").select("doc_id", F.md5(F.array_join(S.six_frames(_dna("text")), "|")).alias("md5"))


def path_names(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("a/b.c/"), F.regexp_replace("p_name", " ", "."), F.lit("_"), key, F.when(F.col("p_partkey") % 3 == 0, ".fna.gz").when(F.col("p_partkey") % 3 == 1, ".faa").otherwise(".fa.x"))
    accession = F.concat(F.lit("RS_GCF_"), F.lpad(key, 9, "0"), F.lit(".1"))
    return _table(spark, d, "part").select("p_partkey", S.base_name(path).alias("base"), P.genome_path(accession).alias("path"))


def zipped_mates(spark: SparkSession, d: str) -> DataFrame:
    """Customers alternate as mates; both sides must have the same number, so an odd last one is left out."""
    both = _table(spark, d, "customer").select(F.lit(0).alias("file_no"), F.col("c_custkey").cast("long").alias("read_no"), F.col("c_name").alias("id"))
    one, two = B.split_interleaved(both)
    one = one.join(two.select("read_no"), "read_no", "left_semi").select("file_no", "read_no", "id")
    return B.zip_records(r1=one, r2=two).select("read_no", F.col("r1.id").alias("first"), F.col("r2.id").alias("second"))


def _genomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of seven files; names repeat."""
    docs = _table(spark, d, "documents").where("doc_id is not null")
    return docs.select((F.col("doc_id") % 7).cast("int").alias("file_no"), F.col("doc_id").cast("long").alias("read_no"), F.concat(F.lit("g"), (F.col("doc_id") % 613).cast("string")).alias("id"), _dna("text").alias("seq"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"), F.lit(".fa")).alias("file"))


def _conversion(spark: SparkSession, step: int) -> DataFrame:
    return spark.range(613).where(F.col("id") % step != 0).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("seq_id"), (100 + F.col("id") % 25).alias("tax_id"))


def usable_genomes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = index.usable_genomes(_genomes(spark, d), _conversion(spark, 5), T.closure(n))
    return out.select("seq", "name", "tax_id", F.md5("bases").alias("md5"))


def usable_genomes_within(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = index.usable_genomes(_genomes(spark, d), _conversion(spark, 5), T.closure(n), within=11, ignore_uncategorised=True)
    return out.select("seq", "name", "tax_id", F.md5("bases").alias("md5"))


def genome_starts(spark: SparkSession, d: str) -> DataFrame:
    genomes = _genomes(spark, d).select(F.col("read_no").alias("seq"), F.expr("if(read_no % 10 = 0, substring(seq, 1, cast(read_no % 20 as int)), seq)").alias("bases"))
    return X.genome_text(genomes).select("seq", F.length("bases").alias("n"), "start")


def header_taxa(spark: SparkSession, d: str) -> DataFrame:
    files = spark.range(6).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".fa")).alias("file"), (F.col("id") + 100).alias("tax_id"))
    return P.file_header_map(_genomes(spark, d), files)


def genome_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Parts as sequences of 40 taxa, some with consecutive accessions."""
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 4 == 0, "N").otherwise("NC_"), F.lpad(key.cast("string"), 8, "0"))
    return T.taxon_lengths(_table(spark, d, "part").select(name.alias("name"), F.expr("p_partkey div 10 % 40").cast("long").alias("tax_id"), (key * 7 + 100).cast("long").alias("length")))


def given_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    own = _table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("tax_id"), (F.col("s_suppkey") + 1).cast("long").alias("length"))
    inner = _table(spark, d, "nation").where("n_nationkey % 2 = 1").select((F.col("n_nationkey") + 100).cast("long").alias("tax_id"), F.lit(77).cast("long").alias("length"))
    return T.infer_lengths(own.unionByName(inner), T.closure(n), given=True)


def accession_taxa(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("accession"), (F.col("s_nationkey") + 100).alias("taxid"))
    return P.taxids_of(_table(spark, d, "part").select(F.concat_ws(".", F.concat(F.lit("A"), F.col("p_partkey").cast("string")), (F.col("p_partkey") % 3).cast("string")).alias("accession")), table)


def listed_accessions(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string"), F.lit(".1")).alias("version"), (F.col("s_nationkey") + 100).alias("taxid"))
    return P.known_accessions(table, _table(spark, d, "part").select(F.concat_ws(".", F.concat(F.lit("A"), F.col("p_partkey").cast("string")), (F.col("p_partkey") % 3).cast("string")).alias("id")))


def assemblies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as lines of an assembly summary."""
    key = F.col("s_suppkey")
    fields = [F.lit("x")] * 4 + [F.when(key % 3 == 0, "reference genome").otherwise("na"), key.cast("string"), (F.col("s_nationkey") + 100).cast("string")] + [F.lit("x")] * 3
    fields += [F.when(key % 5 == 0, "replaced").otherwise("latest"), F.when(key % 2 == 0, "Complete Genome").otherwise("Contig")] + [F.lit("x")] * 7 + [F.concat(F.lit("ftp://h/GCF_"), key.cast("string")), F.when(key % 4 == 0, F.lit("na")).otherwise(F.concat(F.lit("ftp://h/GCA_"), key.cast("string")))]
    out = P.choose_assemblies(_table(spark, d, "supplier").select(F.concat_ws("\t", *fields).alias("value")), level="Complete|Contig", category="reference|na")
    return out.select("taxid", "species_taxid", P.sequence_file(F.col("path")).alias("file"))


def path_tree(spark: SparkSession, d: str) -> DataFrame:
    region, nation = _table(spark, d, "region"), _table(spark, d, "nation")
    top = region.select(F.col("r_regionkey").alias("row_no"), F.concat("r_name", F.lit(";")).alias("path"), (F.col("r_regionkey") + 10).cast("long").alias("tax_id"), F.lit("domain").alias("rank"))
    low = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 1000).alias("row_no"), F.concat("r_name", F.lit(";"), "n_name", F.lit(";")).alias("path"), (F.col("n_nationkey") + 100).cast("long").alias("tax_id"), F.lit("phylum").alias("rank"))
    return P.tree_from_paths(top.unionByName(low)).select("tax_id", "parent_id", "rank", "name")


def barcode_background(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the first 700 parts only, as the feature has it."""
    codes = _table(spark, d, "part").select(F.lit(0).alias("file_no"), F.col("p_partkey").alias("read_no"), _barcode("p_partkey").alias("barcode"))
    return B.barcode_counts(_table(spark, d, "supplier").select(_barcode("s_suppkey").alias("barcode")), codes, 700)


def translated_barcodes(spark: SparkSession, d: str) -> DataFrame:
    table = {a + b: f"{a.lower()}{i}" for i, a in enumerate("ACGT") for b in "ACGT"}
    return _table(spark, d, "part").select("p_partkey", B.translate_barcode(_barcode("p_partkey"), table).alias("names"))


QUERIES = {f.__name__: f for f in (read_counts, classified_share, clade_report_scores, clade_report_matches, clade_report_counts, clade_walk, classified_hits, expanded_lca, expanded_3, general_tree, named_targets, present_tree, merged_seq_taxa, promoted_ids, native_report, metaphlan_lines, cami_lines, document_frames, path_names, zipped_mates, usable_genomes, usable_genomes_within, genome_starts, header_taxa, genome_lengths, given_sizes, accession_taxa, listed_accessions, assemblies, path_tree, barcode_background, translated_barcodes)}

COUNTS = f"""kept AS (SELECT * FROM items WHERE tax <> 0), m AS (SELECT read, count(*) AS m, CASE WHEN arg_min(score, no) > arg_min(second, no) THEN 1.0 ELSE 0.0 END AS u FROM kept GROUP BY read),
own AS (SELECT CASE WHEN n.tax_id IS NULL THEN {ROOT} ELSE tax END AS tax_id, sum(1.0::DOUBLE / m) AS reads, sum(u) AS uniq FROM kept JOIN m USING (read) LEFT JOIN nodes n ON n.tax_id = tax GROUP BY 1),
clades AS (SELECT up.anc AS tax_id, round(sum(reads), 6) AS reads, sum(uniq)::DOUBLE AS uniq FROM own JOIN up USING (tax_id) GROUP BY up.anc)"""
TREE = f"known AS (SELECT read, CASE WHEN n.tax_id IS NULL AND tax <> 0 THEN {ROOT} ELSE tax END AS tax, score, len, no FROM items LEFT JOIN nodes n ON n.tax_id = tax)"
DNA = f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"
GENOMES = f"g AS (SELECT doc_id % 7 AS file_no, doc_id AS read_no, 'g' || (doc_id % 613) AS id, doc_id % 613 AS i, {DNA} AS seq FROM documents WHERE doc_id IS NOT NULL)"
TARGETS = f"t AS (SELECT l_orderkey AS read, CASE WHEN l_orderkey % 100 = 17 AND l_linenumber = 1 THEN 5 WHEN l_linenumber = 5 THEN s_nationkey + 100 ELSE l_suppkey + {SUPPLIER} END AS tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
FRAME = "array_to_string(list_transform(regexp_extract_all(substr({s}, {f} + 1), '...'), lambda c: substr('{code}', CAST(16 * strpos('TCAG', c[1]) + 4 * strpos('TCAG', c[2]) + strpos('TCAG', c[3]) - 20 AS BIGINT), 1)), '')"

SQL = {
    "read_counts": f"WITH RECURSIVE {ITEMS}, {COUNTS} SELECT tax_id, reads, uniq FROM clades",
    "classified_share": f"WITH RECURSIVE {ITEMS}, r AS (SELECT read, max(CASE WHEN tax <> 0 THEN 1 ELSE 0 END) AS c FROM items GROUP BY read) SELECT count(*) AS processed, CAST(sum(c) AS BIGINT) AS classified, round(100 * sum(c) / count(*), 6) AS percent FROM r",
    "clade_report_scores": f"""WITH RECURSIVE {ITEMS}, {TREE}, ok AS (SELECT * FROM known WHERE score >= 5000 AND len >= 5), t AS (SELECT DISTINCT read, tax FROM ok WHERE tax <> 0), {ABOVE},
first AS (SELECT read, arg_min(score, no) AS score FROM ok GROUP BY read), own AS (
  SELECT lca AS tax_id, CAST(count(*) AS DOUBLE) AS own, max(score) AS score FROM lca JOIN first USING (read) GROUP BY ALL
  UNION ALL SELECT 0, CAST(count(*) AS DOUBLE), 0 FROM (SELECT DISTINCT read FROM ok WHERE read NOT IN (SELECT read FROM t)) HAVING count(*) > 0
), sums AS (SELECT anc AS tax_id, sum(own) AS c, max(score) AS score FROM own JOIN up USING (tax_id) GROUP BY anc UNION ALL SELECT tax_id, own, 0 FROM own WHERE tax_id = 0), ids AS (SELECT tax_id FROM nodes UNION SELECT tax_id FROM own)
SELECT i.tax_id, COALESCE(c, 0.0) AS clade_reads, COALESCE(own, 0.0) AS own_reads, round(100 * COALESCE(c, 0.0) / (SELECT sum(own) FROM own), 6) AS percent, COALESCE(s.score, 0) AS score FROM ids i LEFT JOIN sums s USING (tax_id) LEFT JOIN own o ON o.tax_id = i.tax_id""",
    "clade_report_matches": f"""WITH RECURSIVE {ITEMS}, {TREE}, own AS (SELECT tax AS tax_id, sum(1.0::DOUBLE / no) AS own FROM known GROUP BY tax), sums AS (SELECT anc AS tax_id, sum(own) AS c FROM own JOIN up USING (tax_id) GROUP BY anc UNION ALL SELECT tax_id, own FROM own WHERE tax_id = 0)
SELECT tax_id, round(c, 6) AS clade_reads, round(COALESCE(own, 0.0), 6) AS own_reads FROM sums LEFT JOIN own USING (tax_id)""",
    "clade_report_counts": f"""WITH RECURSIVE {NODES}, counts AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 0 WHEN o_orderkey % 100 = 1 THEN 5 ELSE 100 + o_orderkey % 25 END AS tax_id, CAST(o_orderkey % 37 AS DOUBLE) AS n, o_orderkey AS no FROM orders),
own AS (SELECT tax_id, arg_max(n, no) AS own FROM counts WHERE tax_id = 0 OR tax_id IN (SELECT tax_id FROM nodes) GROUP BY tax_id), sums AS (SELECT anc AS tax_id, sum(own) AS c FROM own JOIN up USING (tax_id) GROUP BY anc UNION ALL SELECT tax_id, own FROM own WHERE tax_id = 0),
ids AS (SELECT tax_id FROM nodes UNION SELECT tax_id FROM own)
SELECT i.tax_id, COALESCE(c, 0.0) AS clade_reads, COALESCE(own, 0.0) AS own_reads, round(100 * COALESCE(c, 0.0) / (SELECT sum(n) FROM counts), 6) AS percent FROM ids i LEFT JOIN sums s USING (tax_id) LEFT JOIN own o ON o.tax_id = i.tax_id""",
    "clade_walk": f"""WITH RECURSIVE {ITEMS}, {TREE}, t AS (SELECT DISTINCT read, tax FROM known WHERE tax <> 0), {ABOVE}, own AS (SELECT lca AS tax_id, count(*) AS own FROM lca GROUP BY ALL), sums AS (SELECT anc, CAST(sum(own) AS BIGINT) AS c FROM own JOIN up USING (tax_id) GROUP BY anc)
SELECT string_agg(s.c || ':' || s.anc, '|' ORDER BY depth DESC) AS path, up.tax_id, CAST(count(*) - 1 AS INTEGER) AS depth, max(n.name) AS name, max(n.rank) AS rank FROM up JOIN sums s USING (anc) JOIN nodes n ON n.tax_id = up.tax_id WHERE up.tax_id IN (SELECT anc FROM sums) GROUP BY up.tax_id""",
    "classified_hits": f"""WITH RECURSIVE {NODES}, h AS (
  SELECT l_orderkey AS read, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS strand, l_linenumber AS hit, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 9 + l_linenumber % 2 ELSE min(l_suppkey) END AS seq, l_linenumber * 31 AS off, CASE WHEN CAST(max(l_quantity) AS INTEGER) < 35 THEN 30 ELSE 40 END AS len FROM lineitem GROUP BY l_orderkey, l_linenumber
), g0 AS (SELECT * FROM h WHERE seq > 0), g1 AS (
  SELECT *, sum(CASE WHEN strand = 1 THEN (len - 15) * (len - 15) ELSE 0 END) OVER w AS p, sum(CASE WHEN strand = -1 THEN (len - 15) * (len - 15) ELSE 0 END) OVER w AS m FROM g0 WINDOW w AS (PARTITION BY read)
), g2 AS (SELECT *, CASE WHEN p > m + m // 100 THEN 1 WHEN m > p + p // 100 THEN -1 ELSE 0 END AS one FROM g1), g3 AS (SELECT * FROM g2 WHERE one = 0 OR one = strand), g4 AS (
  SELECT *, CASE WHEN one <> 0 AND lag(seq) OVER w = seq AND lag(off) OVER w + lag(len) OVER w + 1 = off THEN 0 ELSE 1 END AS new FROM g3 WINDOW w AS (PARTITION BY read, strand ORDER BY hit, seq)
), g5 AS (SELECT *, sum(new) OVER (PARTITION BY read, strand ORDER BY hit, seq ROWS UNBOUNDED PRECEDING) AS part FROM g4), g6 AS (SELECT read, strand, seq, part, sum(len) AS len FROM g5 GROUP BY ALL),
s AS (SELECT read, strand, seq, sum((len - 15) * (len - 15)) AS score, sum(len) AS len FROM g6 GROUP BY read, strand, seq), r AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, strand, seq) AS r FROM s),
facts AS (SELECT read, max(score) FILTER (WHERE r = 1) AS best, COALESCE(max(score) FILTER (WHERE r = 2), 0) AS second, max(len) FILTER (WHERE r = 1) AS len FROM r GROUP BY read),
best AS (SELECT DISTINCT read, seq FROM r JOIN facts USING (read) WHERE score = best), named AS (
  SELECT read, seq, s_name AS name, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey + {SUPPLIER} END AS tax FROM best JOIN supplier ON s_suppkey = seq
), size AS (SELECT read, count(*) AS n, bool_or(tax IS NULL) AS outside FROM (SELECT DISTINCT read, seq FROM best) JOIN named USING (read, seq) GROUP BY read),
t AS (SELECT DISTINCT read, tax FROM named JOIN size USING (read) WHERE n > 1 AND NOT outside), {ABOVE}, found AS (
  SELECT read, name AS seqid, COALESCE(tax, {ROOT}) AS tax FROM named JOIN size USING (read) WHERE n = 1
  UNION ALL SELECT read, 'no rank', {ROOT} FROM size WHERE n > 1 AND outside
  UNION ALL SELECT read, rank, lca FROM lca JOIN nodes ON tax_id = lca
)
SELECT CAST(o_orderkey AS VARCHAR) AS "readID", COALESCE(seqid, 'unclassified') AS "seqID", CAST(COALESCE(tax, 0) AS BIGINT) AS "taxID", CAST(COALESCE(best, 0) AS BIGINT) AS score, CAST(CASE WHEN tax IS NULL THEN 0 ELSE second END AS BIGINT) AS "2ndBestScore", CAST(COALESCE(len, 0) AS INTEGER) AS "hitLength", 100 AS "queryLength", 1 AS "numMatches"
FROM orders LEFT JOIN found ON found.read = o_orderkey LEFT JOIN facts ON facts.read = o_orderkey""",
    "expanded_lca": f"""WITH RECURSIVE {NODES}, t0 AS ({TARGETS[6:-1]}), size AS (SELECT read, count(*) AS m, bool_or(tax = 5) AS outside FROM t0 GROUP BY read HAVING count(*) > 1), t AS (SELECT DISTINCT read, tax FROM t0 JOIN size USING (read) WHERE NOT outside), {ABOVE}
SELECT DISTINCT t.read, CAST(lca AS BIGINT) AS tax_id, CAST(n.tax_id AS BIGINT) AS child FROM t JOIN lca USING (read) JOIN up ON up.tax_id = tax JOIN nodes n ON n.tax_id = up.anc WHERE n.parent_id = lca AND n.tax_id <> n.parent_id
UNION ALL SELECT read, NULL, tax FROM t0 JOIN size USING (read) WHERE outside""",
    "expanded_3": f"""WITH RECURSIVE {NODES}, t0 AS ({TARGETS[6:-1]}), size AS (SELECT read, count(*) AS m, bool_or(tax = 5) AS outside FROM t0 GROUP BY read HAVING count(*) > 3), t AS (SELECT DISTINCT read, tax FROM t0 JOIN size USING (read) WHERE NOT outside),
own AS (SELECT tax_id, CASE rank WHEN 'species' THEN 1 WHEN 'family' THEN 3 WHEN 'superkingdom' THEN 8 ELSE 9 END AS own FROM nodes), at_level AS (
  SELECT up.tax_id, level, arg_min(anc, own) AS a FROM up JOIN own ON own.tax_id = anc CROSS JOIN range(1, 9) r(level) WHERE own >= level AND own < 9 GROUP BY ALL
), lifted AS (SELECT DISTINCT read, level, a FROM t JOIN at_level ON tax = tax_id UNION SELECT read, 0, tax FROM t), fits AS (SELECT read, min(level) AS top FROM (SELECT read, level FROM lifted GROUP BY ALL HAVING count(*) <= 3) GROUP BY read HAVING min(level) > 0),
next AS (SELECT l.read, f.top, l.a AS child, arg_min(up.anc, up.depth) AS found, arg_min(own.own, up.depth) AS own FROM lifted l JOIN fits f ON f.read = l.read AND l.level = f.top - 1 JOIN up ON up.tax_id = l.a AND up.depth > 0 JOIN own ON own.tax_id = up.anc WHERE own.own >= f.top GROUP BY ALL)
SELECT n.read, CAST(found AS BIGINT) AS tax_id, CAST(child AS BIGINT) AS child FROM next n JOIN lifted l ON l.read = n.read AND l.level = n.top AND l.a = n.found WHERE own = top
UNION ALL SELECT read, NULL, tax FROM t0 JOIN size USING (read) WHERE outside""",
    "general_tree": f"WITH RECURSIVE {NODES} SELECT tax_id, anc, CAST(depth AS INTEGER) AS depth FROM up",
    "named_targets": f"WITH RECURSIVE {NODES}, {TARGETS} SELECT DISTINCT CAST(tax AS BIGINT) AS tax_id, COALESCE(n.tax_id, {ROOT}) AS known_id, COALESCE(name, 'Unknown') AS name, COALESCE(rank, 'no rank') AS rank FROM t LEFT JOIN nodes n ON n.tax_id = tax",
    "present_tree": f"WITH RECURSIVE {NODES} SELECT tax_id, parent_id FROM nodes WHERE tax_id IN (SELECT anc FROM up JOIN supplier ON s_suppkey + {SUPPLIER} = tax_id WHERE s_acctbal > 5000)",
    "merged_seq_taxa": f"WITH RECURSIVE {NODES}, t AS (SELECT DISTINCT l_partkey AS read, l_suppkey + {SUPPLIER} AS tax FROM lineitem), {ABOVE} SELECT read AS seq_id, CAST(lca AS BIGINT) AS tax_id FROM lca",
    "promoted_ids": f"WITH RECURSIVE {NODES} SELECT n.tax_id, max(u.anc) AS promoted FROM nodes n LEFT JOIN (SELECT up.tax_id, anc FROM up JOIN nodes a ON a.tax_id = anc WHERE a.rank = 'family') u ON u.tax_id = n.tax_id GROUP BY n.tax_id",
    "native_report": f"""WITH RECURSIVE {ITEMS}, {COUNTS}, below AS (SELECT parent_id AS tax_id, sum(reads) AS below FROM clades JOIN nodes USING (tax_id) WHERE tax_id <> parent_id GROUP BY parent_id)
SELECT (SELECT string_agg(CAST(anc AS VARCHAR), '|' ORDER BY depth DESC) FROM up WHERE up.tax_id = c.tax_id) AS path, c.tax_id, CASE rank WHEN 'no rank' THEN 0 WHEN 'superkingdom' THEN 1 WHEN 'family' THEN 2 ELSE 3 END AS depth,
  CASE rank WHEN 'no rank' THEN 'R' WHEN 'superkingdom' THEN 'D' WHEN 'family' THEN 'F' ELSE 'S' END AS code, name, round(reads, 3) AS reads, round(reads - COALESCE(below, 0.0), 3) + 0.0 AS own FROM clades c JOIN nodes USING (tax_id) LEFT JOIN below USING (tax_id)""",
    "metaphlan_lines": f"SELECT 'd__' || r_name || '|f__' || n_name || '|s__' || s_name || chr(9) || (r_regionkey + 10) || '|' || (n_nationkey + 100) || '|' || (s_suppkey + {SUPPLIER}) || chr(9) || printf('%.5f', 100 * (s_suppkey / 4096)) || chr(9) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cami_lines": f"SELECT (s_suppkey + {SUPPLIER}) || chr(9) || 'species' || chr(9) || (r_regionkey + 10) || '|' || (n_nationkey + 100) || '|' || (s_suppkey + {SUPPLIER}) || chr(9) || r_name || '|' || n_name || '|' || s_name || chr(9) || printf('%.5f', 100 * (s_suppkey / 4096)) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "document_frames": f"WITH s AS (SELECT doc_id, {DNA} AS a FROM documents), p AS (SELECT doc_id, a, reverse(translate(a, 'ACGT', 'TGCA')) AS b FROM s) SELECT doc_id, md5(" + " || '|' || ".join(FRAME.format(s=s, f=f, code=S.CODE) for s in "ab" for f in range(3)) + ") AS md5 FROM p",
    "path_names": """WITH x AS (SELECT p_partkey, 'a/b.c/' || replace(p_name, ' ', '.') || '_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.fna.gz' WHEN 1 THEN '.faa' ELSE '.fa.x' END AS path, 'GCF_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1' AS a FROM part), y AS (SELECT *, regexp_replace(substr(path, 7), '\\.[^.]*$', '') AS b FROM x)
SELECT p_partkey, regexp_replace(b, '\\.(fna|fa|fasta|faa)$', '') AS base, 'GCF/' || substr(a, 5, 3) || '/' || substr(a, 8, 3) || '/' || substr(a, 11, 3) || '/' || a || '_genomic.fna.gz' AS path FROM y""",
    "zipped_mates": "SELECT a.c_custkey // 2 AS read_no, a.c_name AS first, b.c_name AS second FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 0",
    "usable_genomes": f"WITH {GENOMES}, f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_no, read_no) = 1) SELECT row_number() OVER (ORDER BY file_no, read_no) - 1 AS seq, id AS name, CASE WHEN i % 5 <> 0 THEN 100 + i % 25 END AS tax_id, md5(seq) AS md5 FROM f",
    "usable_genomes_within": f"WITH {GENOMES}, f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_no, read_no) = 1) SELECT row_number() OVER (ORDER BY file_no, read_no) - 1 AS seq, id AS name, 100 + i % 25 AS tax_id, md5(seq) AS md5 FROM f JOIN nation ON n_nationkey = i % 25 WHERE i % 5 <> 0 AND n_regionkey = 1",
    "genome_starts": f"WITH {GENOMES}, k AS (SELECT read_no AS seq, length(CASE WHEN read_no % 10 = 0 THEN substr(seq, 1, read_no % 20) ELSE seq END) AS n FROM g) SELECT seq, CAST(n AS INTEGER) AS n, CAST(COALESCE(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k WHERE n > 10",
    "header_taxa": f"WITH {GENOMES}, l AS (SELECT id, arg_max(file_no, row(file_no, read_no)) AS f FROM g GROUP BY id) SELECT id AS seq_id, CASE WHEN f < 6 THEN f + 100 END AS tax_id FROM l",
    "genome_lengths": """WITH s AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'N' ELSE 'NC_' END || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name, p_partkey // 10 % 40 AS tax_id, p_partkey * 7 + 100 AS length, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS number FROM part),
n AS (SELECT *, CASE WHEN lag(tax_id) OVER w = tax_id AND lag(number) OVER w + 1 = number THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (ORDER BY name)), r AS (SELECT *, sum(new) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS run FROM n), x AS (SELECT tax_id, run, sum(length) AS length FROM r GROUP BY ALL)
SELECT CAST(tax_id AS BIGINT) AS tax_id, CAST(max(length) AS BIGINT) AS length FROM x GROUP BY tax_id""",
    "given_sizes": f"""WITH RECURSIVE {NODES}, own AS (SELECT s_suppkey + {SUPPLIER} AS tax_id, s_suppkey + 1 AS length FROM supplier UNION ALL SELECT n_nationkey + 100, 77 FROM nation WHERE n_nationkey % 2 = 1), leaf AS (SELECT * FROM own WHERE tax_id NOT IN (SELECT parent_id FROM nodes)),
a AS (SELECT anc AS tax_id, length FROM leaf JOIN up USING (tax_id) WHERE depth > 0 UNION ALL SELECT tax_id, length FROM own), mean AS (SELECT tax_id, CAST(sum(length) AS BIGINT) // count(*) AS length FROM a GROUP BY tax_id)
SELECT tax_id, CAST(COALESCE(own.length, mean.length) AS BIGINT) AS length FROM mean LEFT JOIN own USING (tax_id)""",
    "accession_taxa": "SELECT 'A' || p_partkey || '.' || (p_partkey % 3) AS accession, CAST(COALESCE(s_nationkey + 100, 1) AS BIGINT) AS taxid FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "listed_accessions": "SELECT 'A' || s_suppkey || '.1' AS version, s_nationkey + 100 AS taxid FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 1)",
    "assemblies": """SELECT CAST(s_suppkey AS BIGINT) AS taxid, CAST(s_nationkey + 100 AS BIGINT) AS species_taxid, 'ftp://h/' || p || s_suppkey || '/' || p || s_suppkey || '_genomic.fna.gz' AS file FROM supplier CROSS JOIN (VALUES ('GCF_'), ('GCA_')) v(p) WHERE s_suppkey % 5 <> 0 AND (p = 'GCF_' OR s_suppkey % 4 <> 0)""",
    "path_tree": "SELECT CAST(r_regionkey + 10 AS BIGINT) AS tax_id, CAST(1 AS BIGINT) AS parent_id, 'domain' AS rank, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'phylum', n_name FROM nation",
    "barcode_background": """WITH b AS (SELECT translate(lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0'), '0123456789', 'ACGTACGTAC') AS barcode FROM part ORDER BY p_partkey LIMIT 700), l AS (SELECT DISTINCT translate(lpad(CAST(s_suppkey % 1000000 AS VARCHAR), 6, '0'), '0123456789', 'ACGTACGTAC') AS barcode FROM supplier)
SELECT l.barcode, 1 + count(b.barcode) AS n FROM l LEFT JOIN b USING (barcode) GROUP BY l.barcode""",
    "translated_barcodes": """WITH b AS (SELECT p_partkey, translate(lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0'), '0123456789', 'ACGTACGTAC') AS c FROM part)
SELECT p_partkey, array_to_string(list_transform([1, 3, 5], lambda i: lower(substr(c, i, 1)) || (strpos('ACGT', substr(c, i, 1)) - 1)), '-') AS names FROM b""",
}
