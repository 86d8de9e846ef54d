"""Registered queries of the sequence operators over the driver's tables, and the SQL that repeats them.

The tables hold no genomes: regions, nations and suppliers stand in for a taxonomy (root 1, then 10 + region,
100 + nation, 10000000 + supplier), line items for classification rows, texts for sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions import kernels, read_format
from taxaflow.functions import sequence as S
from taxaflow.operators import classify as C
from taxaflow.operators import prepare as P
from taxaflow.operators import reads as B
from taxaflow.operators import results as R
from taxaflow.operators import search as X
from taxaflow.operators import taxonomy as T
from taxaflow.sources import sinks

ROOT, SUPPLIER = 1, 10_000_000
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 13)[:52]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    region = _table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("tax_id"), F.lit(ROOT).cast("long").alias("parent_id"), F.lit("superkingdom").alias("rank"), F.col("r_name").alias("name"))
    nation = _table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("tax_id"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id"), F.lit("family").alias("rank"), F.col("n_name").alias("name"))
    supplier = _table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("tax_id"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"), F.lit("species").alias("rank"), F.col("s_name").alias("name"))
    root = spark.range(1).select(F.lit(ROOT).cast("long").alias("tax_id"), F.lit(ROOT).cast("long").alias("parent_id"), F.lit("no rank").alias("rank"), F.lit("root").alias("name"))
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as classification rows; prices and quantities are rounded, ties to even, as the SQL's casts do."""
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("readID"), (F.col("l_suppkey") + SUPPLIER).alias("taxID"), F.rint("l_extendedprice").cast("long").alias("score"), F.floor(F.col("l_tax") * 1_000_000).alias("2ndBestScore"), F.rint("l_quantity").cast("int").alias("hitLength"), F.lit(50).alias("queryLength"), F.col("l_linenumber").cast("long").alias("row_no"))


def _dna(text: str) -> F.Column:
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


NODES = f"""nodes AS (
  SELECT CAST({ROOT} AS BIGINT) AS tax_id, CAST({ROOT} AS BIGINT) AS parent_id, 'no rank' AS rank, 'root' AS name
  UNION ALL SELECT r_regionkey + 10, {ROOT}, 'superkingdom', r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'family', n_name FROM nation
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + 100, 'species', s_name FROM supplier
), up AS (
  SELECT tax_id, tax_id AS anc, 0 AS depth FROM nodes
  UNION ALL SELECT up.tax_id, n.parent_id, up.depth + 1 FROM up JOIN nodes n ON up.anc = n.tax_id WHERE n.tax_id <> n.parent_id
), hits AS (
  SELECT l_orderkey AS readid, l_suppkey + {SUPPLIER} AS taxid, CAST(l_quantity AS INTEGER) AS len, l_linenumber AS no FROM lineitem
)"""
LCA = f"""{NODES}, t AS (SELECT DISTINCT readid, taxid FROM hits), c AS (
  SELECT readid, anc, count(*) AS c FROM t JOIN up ON taxid = tax_id WHERE anc <> {ROOT} GROUP BY ALL
), m AS (SELECT readid, count(*) AS m FROM t GROUP BY ALL), height AS (SELECT tax_id, max(depth) AS h FROM up GROUP BY ALL), lca AS (
  SELECT m.readid AS read, COALESCE(max_by(f.anc, f.h), {ROOT}) AS lca FROM m LEFT JOIN (SELECT c.readid, c.c, anc, h FROM c JOIN height ON anc = tax_id) f ON f.readid = m.readid AND f.c = m.m GROUP BY ALL
)"""

LINE_HITS = """h AS (
  SELECT l_orderkey AS read, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS strand, l_linenumber AS hit, l_suppkey % 2 AS seq, l_linenumber * 31 AS off, CASE WHEN CAST(l_quantity AS INTEGER) < 35 THEN 30 ELSE CAST(l_quantity AS INTEGER) END AS len
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)
)"""
BARCODE = "translate(lpad(CAST({} % 1000000 AS VARCHAR), 6, '0'), '0123456789', 'ACGTACGTAC')"


def tax_closure(spark: SparkSession, d: str) -> DataFrame:
    return T.closure(nodes(spark, d))


def tax_lca(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.lca(rows(spark, d).select(F.col("readID").alias("read"), F.col("taxID").alias("tax_id")), T.closure(n), ROOT).select("read", "lca")


def tax_promote(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.promote(rows(spark, d).select(F.col("readID").alias("read"), F.col("taxID").alias("tax_id")), n, T.closure(n), "family")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of reads: suppliers, of each fifth line its nation, of each line whose order ends in 17 a taxon that isn't in the tree."""
    rows = _table(spark, d, "lineitem").join(F.broadcast(_table(spark, d, "supplier")), F.col("l_suppkey") == F.col("s_suppkey"))
    tax = F.when((F.col("l_orderkey") % 100 == 17) & (F.col("l_linenumber") == 1), F.lit(5).cast("long")).when(F.col("l_linenumber") == 5, (F.col("s_nationkey") + 100).cast("long")).otherwise(F.col("l_suppkey") + SUPPLIER)
    return rows.select(F.col("l_orderkey").alias("read"), tax.alias("tax_id"))


def tax_reduce_to_3(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.reduce_to_k(_targets(spark, d), n, T.closure(n), ROOT, 3)


def tax_lineage(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.lineage(T.closure(n), n, ROOT)


def tax_subtree(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return T.subtree(n, T.closure(n), 11).select("tax_id")


def clade_report(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = R.clade_report(rows(spark, d), n, T.closure(n), ROOT)
    return out.select("tax_id", "clade_reads", "own_reads", F.round("percent", 6).alias("percent"))


def clade_report_shared(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = R.clade_report(rows(spark, d), n, T.closure(n), ROOT, with_lca=False)
    return out.select("tax_id", F.round("clade_reads", 4).alias("clade_reads"), F.round("own_reads", 4).alias("own_reads"))


def taxon_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    own = _table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select((F.col("s_suppkey") + SUPPLIER).alias("tax_id"), (F.col("s_suppkey") * 7 + 1000).alias("length"))
    inner = _table(spark, d, "nation").where("n_nationkey % 2 = 1").select((F.col("n_nationkey") + 100).cast("long").alias("tax_id"), (F.col("n_nationkey") * 11 + 50_000).cast("long").alias("length"))
    return T.infer_lengths(own.unionByName(inner), T.closure(n))


def hit_scores(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.lit(1).alias("strand"), F.col("l_linenumber").alias("hit"), F.col("l_suppkey").alias("seq"), F.col("l_quantity").cast("int").alias("length"))
    return R.best_hits(R.score_hits(li)).select("read", "seq", "score", "second")


def coalesced_assignments(spark: SparkSession, d: str) -> DataFrame:
    out = R.assignments(rows(spark, d), least_length=10)
    return out.select(F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"), F.round("weight", 8).alias("weight"), "cnt", "uniq")


def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.md5(S.reverse_complement(_dna("text"))).alias("md5"))


def quant_report(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    up = T.closure(n)
    return R.quant_report(rows(spark, d), n, up, taxon_sizes(spark, d), ROOT)


def read_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as reads, documents as genomes: the scan of each strand, before hits of the two are reconciled."""
    genomes = _table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("seq"), _dna("text").alias("bases"))
    reads = _table(spark, d, "benchmark").select(F.col("item_id").alias("read"), _dna("text").alias("seq"))
    return X.search(reads, X.genome_text(genomes), 23, agree=False)


def classified_reads(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as reads, documents as genomes of the nations' taxa."""
    n = nodes(spark, d)
    genomes = _table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("name"), (100 + F.pmod("doc_id", F.lit(25))).alias("tax_id"), _dna("text").alias("bases"))
    reads = _table(spark, d, "benchmark").select(F.col("item_id").alias("read"), F.col("item_id").cast("string").alias("id"), _dna("text").alias("seq")).withColumn("query_length", F.length("seq"))
    hits = X.search(reads.select("read", "seq"), X.genome_text(genomes.select("seq", "bases")), 23).withColumn("mate", F.lit(1))
    return C.classify(reads, hits, genomes, n, T.closure(n), ROOT)


def low_complexity_masks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select("item_id", kernels.dust(_dna("text")).alias("masked"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as hits 31 bases apart, so those of 30 are neighbours."""
    no, size = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    items = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"))
    return items.select(F.col("l_orderkey").alias("read"), F.lit(1).alias("mate"), F.when(no % 3 == 0, -1).otherwise(1).alias("strand"), no.alias("hit"), (F.col("l_suppkey") % 2).alias("seq"), (no * 31).cast("int").alias("offset"), F.when(size < 35, 30).otherwise(size).alias("length"), F.lit(1).cast("long").alias("occurrences"))


def chosen_strands(spark: SparkSession, d: str) -> DataFrame:
    return C.choose_strand(_hits(spark, d)).select("read", "hit", "seq", "pool", "mixed")


def joined_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).withColumn("pool", F.col("strand")).withColumn("mixed", F.lit(False))
    return C.sequence_scores(C.join_adjacent(hits)).select("read", "pool", "seq", "score", "hit_length")


def _barcode(key: str) -> F.Column:
    return F.translate(F.lpad((F.col(key) % 1_000_000).cast("string"), 6, "0"), "0123456789", "ACGTACGTAC")


def corrected_barcodes(spark: SparkSession, d: str) -> DataFrame:
    codes = _table(spark, d, "part").select(F.lit(0).alias("file_no"), F.col("p_partkey").alias("read_no"), _barcode("p_partkey").alias("barcode"), F.lit(None).cast("string").alias("qual"))
    listed = _table(spark, d, "supplier").select(_barcode("s_suppkey").alias("barcode"))
    return B.correct_barcodes(codes, B.barcode_counts(listed, codes, None)).select("read_no", "barcode", "corrected")


def read_segments(spark: SparkSession, d: str) -> DataFrame:
    f = read_format.parse("r1:5:-6:-,bc:0:9;bc:-4:-1,um:hd:1:1:3")
    seq, text = _dna("text"), F.col("text")
    return _table(spark, d, "benchmark").select("item_id", *[read_format.extract(f[p], seq, text).alias(p) for p in ("r1", "bc", "um")])


def document_masks(spark: SparkSession, d: str) -> DataFrame:
    """low_complexity_masks over documents."""
    return _table(spark, d, "documents").select("doc_id", F.md5(kernels.dust(_dna("text"))).alias("md5"))


def document_segments(spark: SparkSession, d: str) -> DataFrame:
    """read_segments over documents."""
    f = read_format.parse("r1:5:-6:-,bc:0:9;bc:-4:-1,um:hd:1:1:3")
    seq, text = _dna("text"), F.col("text")
    return _table(spark, d, "documents").select("doc_id", *[read_format.extract(f[p], seq, text).alias(p) for p in ("r1", "bc", "um")])


def report_lineages(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return sinks.lineage_of(n, T.closure(n), ROOT)


def lineage_tree(spark: SparkSession, d: str) -> DataFrame:
    both = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.tree_from_lineages(both.select(F.col("n_nationkey").alias("row_no"), F.concat(F.lit("d__"), "r_name", F.lit(";p__"), "n_name").alias("lineage"))).select("tax_id", "parent_id", "rank", "name")


MORE = (classified_reads, low_complexity_masks, chosen_strands, joined_hits, corrected_barcodes, read_segments, document_masks, document_segments, report_lineages, lineage_tree)
QUERIES = {f.__name__: f for f in (tax_closure, tax_lca, tax_promote, tax_reduce_to_3, tax_lineage, tax_subtree, clade_report, clade_report_shared, taxon_sizes, hit_scores, coalesced_assignments, reverse_complements, quant_report, read_search, *MORE)}

SQL = {
    "tax_closure": f"WITH RECURSIVE {NODES} SELECT tax_id, anc, CAST(depth AS INTEGER) AS depth FROM up",
    "tax_lca": f"WITH RECURSIVE {LCA} SELECT read, lca FROM lca",
    "tax_promote": f"WITH RECURSIVE {NODES} SELECT DISTINCT readid AS read, 100 + s_nationkey AS tax_id FROM hits JOIN supplier ON taxid = s_suppkey + {SUPPLIER}",
    "tax_reduce_to_3": f"""WITH RECURSIVE {NODES}, t AS (
  SELECT l_orderkey AS read, CASE WHEN l_orderkey % 100 = 17 AND l_linenumber = 1 THEN 5 WHEN l_linenumber = 5 THEN s_nationkey + 100 ELSE l_suppkey + {SUPPLIER} END AS tax_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), m AS (SELECT read, count(*) AS m, bool_or(tax_id = 5) AS outside FROM t GROUP BY read), lifted AS (
  SELECT DISTINCT read, level, CASE level WHEN 0 THEN x.tax_id ELSE a.anc END AS a FROM t JOIN m USING (read) JOIN nodes x USING (tax_id) CROSS JOIN range(0, 9) r(level)
  LEFT JOIN (SELECT up.tax_id, up.anc, CASE n.rank WHEN 'species' THEN 1 WHEN 'family' THEN 3 ELSE 8 END AS own FROM up JOIN nodes n ON n.tax_id = up.anc WHERE n.rank <> 'no rank') a ON a.tax_id = x.tax_id AND a.own >= level
    AND a.own = CASE WHEN x.rank = 'species' AND level <= 1 THEN 1 WHEN level <= 3 AND x.rank IN ('species', 'family') THEN 3 ELSE 8 END
  WHERE m > 3 AND NOT outside
), fits AS (SELECT read, min(level) AS level FROM (SELECT read, level FROM lifted WHERE a IS NOT NULL GROUP BY ALL HAVING count(*) <= 3) GROUP BY ALL)
SELECT DISTINCT read, CAST(tax_id AS BIGINT) AS tax_id FROM t JOIN m USING (read) WHERE m <= 3
UNION ALL SELECT read, NULL FROM m WHERE m > 3 AND outside
UNION ALL SELECT DISTINCT m.read, COALESCE(l.a, {ROOT}) FROM m LEFT JOIN fits f USING (read) LEFT JOIN lifted l ON l.read = f.read AND l.level = f.level WHERE m > 3 AND NOT outside""",
    "tax_lineage": f"WITH RECURSIVE {NODES} SELECT up.tax_id, string_agg(n.name, '|' ORDER BY depth DESC) AS lineage FROM up JOIN nodes n ON n.tax_id = up.anc WHERE up.anc <> {ROOT} GROUP BY ALL",
    "tax_subtree": f"WITH RECURSIVE {NODES} SELECT tax_id FROM up WHERE anc = 11",
    "clade_report": f"""WITH RECURSIVE {LCA}, own AS (SELECT lca AS tax_id, CAST(count(*) AS DOUBLE) AS own FROM lca GROUP BY ALL)
SELECT up.anc AS tax_id, sum(own) AS clade_reads, COALESCE(max(own) FILTER (WHERE up.tax_id = up.anc), 0.0) AS own_reads, round(100 * sum(own) / (SELECT sum(own) FROM own), 6) AS percent FROM own JOIN up USING (tax_id) GROUP BY up.anc""",
    "clade_report_shared": f"""WITH RECURSIVE {NODES}, m AS (SELECT readid, count(*) AS m FROM hits GROUP BY ALL), own AS (SELECT taxid AS tax_id, sum(1.0::DOUBLE / m) AS own FROM hits JOIN m USING (readid) GROUP BY ALL)
SELECT up.anc AS tax_id, round(sum(own), 4) AS clade_reads, round(COALESCE(max(own) FILTER (WHERE up.tax_id = up.anc), 0.0), 4) AS own_reads FROM own JOIN up USING (tax_id) GROUP BY up.anc""",
    "taxon_sizes": f"""WITH RECURSIVE {NODES}, own AS (
  SELECT s_suppkey + {SUPPLIER} AS tax_id, s_suppkey * 7 + 1000 AS length FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT n_nationkey + 100, n_nationkey * 11 + 50000 FROM nation WHERE n_nationkey % 2 = 1
), parents AS (SELECT DISTINCT parent_id FROM nodes WHERE parent_id <> tax_id)
SELECT tax_id, CAST(sum(length) AS BIGINT) // count(*) AS length FROM (
  SELECT tax_id, length FROM own UNION ALL SELECT up.anc, length FROM own JOIN up USING (tax_id) WHERE depth > 0 AND tax_id NOT IN (SELECT parent_id FROM parents)
) GROUP BY tax_id""",
    "hit_scores": """WITH s AS (
  SELECT l_orderkey AS read, l_suppkey AS seq, CAST(sum((q - 15) * (q - 15)) AS BIGINT) AS score
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY ALL) WHERE q >= 23 GROUP BY ALL
), r AS (SELECT *, rank() OVER (PARTITION BY read ORDER BY score DESC) AS r FROM s)
SELECT read, seq, score, CASE WHEN count(*) FILTER (WHERE r = 1) OVER w > 1 THEN score ELSE COALESCE(max(CASE WHEN r > 1 THEN score END) OVER w, 0) END AS second
FROM r WINDOW w AS (PARTITION BY read) QUALIFY r = 1""",
    "coalesced_assignments": f"""WITH x AS (
  SELECT l_orderkey AS read, l_suppkey + {SUPPLIER} AS tax, CAST(l_extendedprice AS BIGINT) AS score, floor(l_tax * 1000000) AS second, CAST(l_quantity AS INTEGER) AS len, l_linenumber AS no FROM lineitem WHERE CAST(l_quantity AS INTEGER) >= 10
), g AS (SELECT read, string_agg(CAST(tax AS VARCHAR), ',' ORDER BY no, tax) AS targets, arg_min(score, row(no, tax, score, second, len)) AS score, arg_min(second, row(no, tax, score, second, len)) AS second, arg_min(len, row(no, tax, score, second, len)) AS len FROM x GROUP BY read)
SELECT targets, round(sum(CASE WHEN 50 - len < 0 THEN 1.0 ELSE pow(0.25, least(50 - len, 11)) END), 8) AS weight, CAST(count(*) AS DOUBLE) AS cnt, sum(CASE WHEN score > second THEN 1.0 ELSE 0.0 END)::DOUBLE AS uniq FROM g GROUP BY targets""",
    "chosen_strands": f"""WITH {LINE_HITS}, s AS (
  SELECT *, sum(CASE WHEN strand = 1 THEN (len - 15) * (len - 15) ELSE 0 END) OVER w AS p, sum(CASE WHEN strand = -1 THEN (len - 15) * (len - 15) ELSE 0 END) OVER w AS m FROM h WINDOW w AS (PARTITION BY read)
), c AS (SELECT *, CASE WHEN p > m + m // 100 THEN 1 WHEN m > p + p // 100 THEN -1 ELSE 0 END AS one FROM s)
SELECT read, hit, seq, strand AS pool, one = 0 AS mixed FROM c WHERE one = 0 OR one = strand""",
    "joined_hits": f"""WITH {LINE_HITS}, g AS (
  SELECT *, CASE WHEN lag(seq) OVER w = seq AND lag(off) OVER w + lag(len) OVER w + 1 = off THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY read, strand ORDER BY hit, seq)
), p AS (SELECT *, sum(new) OVER (PARTITION BY read, strand ORDER BY hit, seq ROWS UNBOUNDED PRECEDING) AS part FROM g), t AS (SELECT read, strand, seq, part, sum(len) AS len FROM p GROUP BY ALL)
SELECT read, strand AS pool, seq, CAST(sum((len - 15) * (len - 15)) AS BIGINT) AS score, CAST(sum(len) AS BIGINT) AS hit_length FROM t GROUP BY read, strand, seq""",
    "corrected_barcodes": f"""WITH b AS (SELECT p_partkey AS read_no, {BARCODE.format("p_partkey")} AS barcode FROM part),
listed AS (SELECT DISTINCT {BARCODE.format("s_suppkey")} AS w FROM supplier), n AS (SELECT w, count(read_no) AS n FROM listed LEFT JOIN b ON w = barcode GROUP BY w),
near AS (SELECT DISTINCT barcode, a AS pos, c AS base, substr(barcode, 1, CAST(a AS BIGINT) - 1) || c || substr(barcode, CAST(a AS BIGINT) + 1) AS w FROM (SELECT DISTINCT barcode FROM b) CROSS JOIN range(1, 7) r(a) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(c)),
f AS (SELECT barcode, w, row_number() OVER (PARTITION BY barcode ORDER BY n DESC, pos, base) AS r FROM near JOIN n USING (w))
SELECT read_no, b.barcode, CASE WHEN l.w IS NOT NULL THEN b.barcode ELSE COALESCE(f.w, 'N') END AS corrected FROM b LEFT JOIN listed l ON l.w = b.barcode LEFT JOIN f ON f.barcode = b.barcode AND f.r = 1""",
    "read_segments": f"""WITH t AS (SELECT item_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS s, regexp_split_to_array(text, '[ \t]') AS words FROM benchmark)
SELECT item_id, reverse(translate(substr(s, 6, length(s) - 10), 'ACGT', 'TGCA')) AS r1, substr(s, 1, 10) || right(s, 4) AS bc, substr(COALESCE(words[2], ''), 2, 3) AS um FROM t""",
    "document_segments": f"""WITH t AS (SELECT doc_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS s, regexp_split_to_array(text, '[ \t]') AS words FROM documents)
SELECT doc_id, reverse(translate(substr(s, 6, greatest(length(s) - 10, 0)), 'ACGT', 'TGCA')) AS r1, substr(s, 1, 10) || right(s, 4) AS bc, substr(COALESCE(words[2], ''), 2, 3) AS um FROM t""",
    "report_lineages": f"""WITH RECURSIVE {NODES} SELECT up.tax_id, string_agg(n.name, '|' ORDER BY depth DESC) AS names, string_agg(CAST(n.tax_id AS VARCHAR), '|' ORDER BY depth DESC) AS ids,
  string_agg(CASE n.rank WHEN 'superkingdom' THEN 'd' ELSE substr(n.rank, 1, 1) END || '__' || n.name, '|' ORDER BY depth DESC) AS prefixed FROM up JOIN nodes n ON n.tax_id = up.anc WHERE n.rank <> 'no rank' GROUP BY up.tax_id""",
    "lineage_tree": """WITH s AS (
  SELECT r_name AS name, 'd' AS p, '' AS above, min(n_nationkey) AS no, 0 AS deep FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
  UNION ALL SELECT n_name, 'p', r_name, n_nationkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
), i AS (SELECT *, CAST(9999999 + row_number() OVER (ORDER BY no, deep) AS BIGINT) AS id FROM s)
SELECT i.id AS tax_id, COALESCE(j.id, 1) AS parent_id, CASE i.p WHEN 'd' THEN 'domain' ELSE 'phylum' END AS rank, i.name FROM i LEFT JOIN i j ON i.p = 'p' AND j.p = 'd' AND j.name = i.above""",
    "low_complexity_masks": f"""WITH t AS (SELECT item_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS s FROM benchmark),
w AS (SELECT item_id, i, substr(s, i, 3) AS w FROM t, range(1, 100000) r(i) WHERE i <= length(s) - 2),
p AS (SELECT a.item_id, a.i, b.i AS j, CASE WHEN a.w = b.w THEN 1 ELSE 0 END AS e FROM w a JOIN w b ON a.item_id = b.item_id AND b.i > a.i AND b.i < a.i + 62),
c AS (SELECT *, sum(e) OVER (PARTITION BY item_id, j ORDER BY i DESC) AS ending FROM p),
d AS (SELECT *, sum(ending) OVER (PARTITION BY item_id, i ORDER BY j) AS pairs FROM c),
e AS (SELECT *, pairs / (j - i) AS score FROM d),
f AS (SELECT *, max(score) OVER (PARTITION BY item_id, i ORDER BY j) AS inner_ FROM e),
g AS (SELECT *, max(inner_) OVER (PARTITION BY item_id, j ORDER BY i DESC) AS best FROM f),
m AS (SELECT DISTINCT item_id, pos FROM (SELECT item_id, unnest(range(i, j + 3)) AS pos FROM g WHERE score > 2 AND score >= best))
SELECT t.item_id, COALESCE(string_agg(CASE WHEN m.pos IS NULL THEN substr(s, r.i, 1) ELSE 'N' END, '' ORDER BY r.i), '') AS masked FROM t LEFT JOIN range(1, 100000) r(i) ON r.i <= length(s) LEFT JOIN m ON m.item_id = t.item_id AND m.pos = r.i GROUP BY t.item_id""",
    "read_search": f"""WITH RECURSIVE g AS (
  SELECT doc_id AS seq, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS s FROM documents WHERE doc_id IS NOT NULL
), starts AS (SELECT seq, length(s) AS n, COALESCE(sum(length(s)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g WHERE length(s) > 10),
whole AS (SELECT string_agg(s, '' ORDER BY seq) AS t FROM g WHERE length(s) > 10),
pieces AS (SELECT k, substr(t, CAST(greatest(k * 1000 - 1000, 0) + 1 AS BIGINT), CAST(CASE WHEN k = 0 THEN 1000 ELSE 2000 END AS BIGINT)) AS piece, greatest(k * 1000 - 1000, 0) AS base FROM whole, range(0, 1000000) r(k) WHERE k * 1000 < length(t)),
ends AS (SELECT k, e, base, substr(piece, CAST(e - 9 AS BIGINT), 10) AS w FROM pieces, range(1, 2001) r(e) WHERE e <= length(piece) AND e >= 10 AND base + e > k * 1000),
b AS (SELECT item_id AS read, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS s FROM benchmark),
reads AS (SELECT read, 1 AS strand, s FROM b UNION ALL SELECT read, -1, reverse(translate(s, 'ACGT', 'TGCA')) FROM b),
froms AS (SELECT read, strand, f, substr(s, CAST(f - 9 AS BIGINT), 10) AS w FROM reads, range(10, 1000) r(f) WHERE f <= length(s)),
grown AS (
  SELECT read, strand, f, k, e, base, 10 AS len FROM froms JOIN ends USING (w)
  UNION ALL SELECT x.read, x.strand, x.f, x.k, x.e, x.base, x.len + 1 FROM grown x JOIN reads r ON r.read = x.read AND r.strand = x.strand JOIN pieces p ON p.k = x.k
  WHERE x.len < x.f AND x.len < x.e AND substr(r.s, CAST(x.f - x.len AS BIGINT), 1) = substr(p.piece, CAST(x.e - x.len AS BIGINT), 1)
), longest AS (SELECT read, strand, f, max(len) AS len FROM grown GROUP BY ALL),
scan AS (
  SELECT read, strand, length(s) AS f FROM reads WHERE length(s) >= 23
  UNION ALL SELECT c.read, c.strand, c.f - COALESCE(l.len, 9) - 1 FROM scan c LEFT JOIN longest l ON l.read = c.read AND l.strand = c.strand AND l.f = c.f WHERE c.f - COALESCE(l.len, 9) - 1 >= 23
), found AS (SELECT c.read, c.strand, c.f, l.len, row_number() OVER (PARTITION BY c.read, c.strand ORDER BY c.f DESC) - 1 AS hit FROM scan c JOIN longest l ON l.read = c.read AND l.strand = c.strand AND l.f = c.f WHERE l.len >= 23),
places AS (SELECT h.*, x.base + x.e - x.len AS pos, count(*) OVER (PARTITION BY h.read, h.strand, h.hit) AS n FROM found h JOIN grown x ON x.read = h.read AND x.strand = h.strand AND x.f = h.f AND x.len = h.len),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY read, strand, hit ORDER BY CASE WHEN n > 40 THEN substr(t, CAST(pos + 1 AS BIGINT), 4000) END) - 1 AS r FROM places p, whole),
kept AS (SELECT *, (n + 39) // 40 AS step FROM ranked),
picked AS (SELECT * FROM kept WHERE n <= 40 OR r % step = 0 OR (n - 1 - r) % step = 0 AND ((n - 1 - r) // step = 0 OR (n + step - 1) // step + (n - 1 - r) // step < 40))
SELECT o.read, CAST(o.strand AS INTEGER) AS strand, CAST(o.hit AS INTEGER) AS hit, CAST(g.seq AS BIGINT) AS seq, CAST(length(r.s) - o.f AS INTEGER) AS "offset", CAST(o.len AS INTEGER) AS length, CAST(o.n AS BIGINT) AS occurrences
FROM (SELECT DISTINCT read, strand, hit, f, len, n, pos + 11 AS place FROM picked) o ASOF JOIN starts g ON o.place >= g.start JOIN reads r ON r.read = o.read AND r.strand = o.strand GROUP BY ALL""",
    "reverse_complements": f"SELECT doc_id, md5(reverse(translate(regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g'), 'ACGT', 'TGCA'))) AS md5 FROM documents",
}
