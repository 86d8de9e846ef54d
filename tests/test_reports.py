"""Strands reconciled, protein search, expanded taxa, native reports, maps and writers on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import read_format
from taxaflow.operators import classify as C
from taxaflow.operators import prepare as P
from taxaflow.operators import reads as R
from taxaflow.operators import search
from taxaflow.operators import taxonomy as T
from taxaflow.sources import index, sinks

NODES = [(1, 1, "no rank", "root"), (2, 1, "superkingdom", "B"), (3, 2, "genus", "G"), (4, 3, "species", "x"), (5, 3, "species", "y"), (6, 2, "genus", "H"), (7, 6, "species", "z"), (8, 4, "no rank", "x8"), (9, 8, "strain", "x9")]


def flip(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


@pytest.fixture(scope="module")
def tree(spark):
    n = spark.createDataFrame(NODES, "tax_id long, parent_id long, rank string, name string")
    return n, T.closure(n).persist()


def test_strands_agree():
    rng = random.Random(8)
    a, b = ("".join(rng.choice("ACGT") for _ in range(200)) for _ in range(2))
    # the forward scan takes a chance hit from the read's end, so its long hit starts late; the reverse one is whole
    read = a[40:130] + "N" + a[131:140]
    one = search.Index((a + flip(a)).encode(), [0, 200], [0, 1])
    found = sorted({(s, o, n) for s, _, _, o, n, _ in one.hits(read, 23, 40)})
    assert found == [(-1, 0, 90), (1, 10, 90)]
    # a base between, then a chance hit at the read's end which eats into the true hit
    text = a + flip(a) + b
    read = a[20:100] + "A" + b[3:30]
    index_ = search.Index(text.encode(), [0, 200, 400], [0, 1, 2])
    raw = {(s, o, n) for s, _, _, o, n, _ in index_.hits(read, 23, 40, agree=False)}
    both = {(s, o, n) for s, _, _, o, n, _ in index_.hits(read, 23, 40)}
    whole = {s: max(n for t, _, n in both if t == s) for s in (1, -1) if any(t == s for t, _, _ in both)}
    assert whole[1] >= max(n for s, _, n in raw if s == 1) and whole[1] == whole[-1]
    for s in (1, -1):  # hits of a strand don't overlap
        spans = sorted((o, o + n) for t, o, n in both if t == s)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_reconciled_and_cut_hits():
    M = search.Match
    read = b"A" * 40
    # forward hit 10..29, reverse hit 15..34 on the read: the forward one is searched from 34 on and spans 10..34
    plus, minus = [M(10, 20, 0, 1)], [M(15, 20, 0, 1)]
    search.reconcile(plus, minus, read, read, lambda s, end: (25, 5, 6) if end == 35 else (0, 0, 0))
    assert plus == [M(5, 25, 5, 6)] and minus == [M(15, 20, 0, 1)]
    # one that doesn't reach exactly the other end stays, as do nested and equal ones
    for back, found in ((M(15, 20, 0, 1), (24, 5, 6)), (M(12, 10, 0, 1), (25, 5, 6)), (M(10, 20, 0, 1), (25, 5, 6))):
        plus, minus = [M(10, 20, 0, 1)], [back]
        search.reconcile(plus, minus, read, read, lambda s, end, found=found: found)
        assert plus == [M(10, 20, 0, 1)] and minus == [back]
    hits = [M(0, 10, 0, 1), M(5, 10, 0, 1), M(14, 4, 0, 1)]
    search.separate(hits)
    assert [(h.offset, h.length) for h in hits] == [(0, 5), (5, 10), (15, 3)]
    hits = [M(0, 20, 0, 1), M(5, 10, 0, 1), M(25, 5, 0, 1)]
    search.separate(hits)
    assert [(h.offset, h.length) for h in hits] == [(0, 20), (5, 0), (25, 5)]


def test_protein_search(spark):
    rng = random.Random(9)
    codons = {v: k for k, v in search._CODONS.items()}
    proteins = ["".join(rng.choice(search.AMINO) for _ in range(60)) for _ in range(2)]
    genomes = spark.createDataFrame(list(enumerate(proteins)), "seq long, bases string")
    coding = "".join(codons[a] for a in proteins[1][5:45])
    reads = spark.createDataFrame([(0, "C" + coding), (1, flip(coding)), (2, "ACGT" * 20), (3, "".join(codons[a] for a in proteins[0][50:] + proteins[1][:10]))], "read long, seq string")
    hits = search.search(reads, search.genome_text(genomes, search.PROTEIN_WIDTH, protein=True), 9, protein=True).collect()
    # a hit doesn't go on from one protein to the next, and the scan skips a letter before each hit
    assert sorted((h.read, h.strand, h.seq, h.length) for h in hits) == [(0, 1, 1, 40), (1, -1, 1, 40), (3, 1, 0, 9), (3, 1, 1, 10)]


def test_expanded_taxa(spark, tree):
    n, up = tree
    rows = spark.createDataFrame([("a", 9), ("a", 5), ("b", 4), ("b", 7), ("b", 1), ("c", 4), ("c", 99), ("d", 9), ("d", 4), ("e", 1), ("e", 1), ("f", 5)], "read string, tax_id long")
    one = {(r.read, r.tax_id, r.child) for r in T.expanded_taxa(rows, n, up, 1, 1).collect()}
    assert one == {("a", 3, 4), ("a", 3, 5), ("b", 2, 3), ("b", 2, 6), ("c", None, 4), ("c", None, 99), ("d", 4, 8)}
    three = rows.where("read in ('a', 'b')").unionByName(spark.createDataFrame([("a", 7), ("b", 5)], "read string, tax_id long"))
    two = {(r.read, r.tax_id, r.child) for r in T.expanded_taxa(three.where("tax_id <> 1"), n, up, 1, 2).collect()}
    assert two == {("a", 3, 4), ("a", 3, 5), ("a", 6, 7), ("b", 3, 4), ("b", 3, 5), ("b", 6, 7)}
    hits = spark.createDataFrame([(1, 1, 1, 0, s, 0, 40, 1) for s in (0, 1)] + [(2, 1, 1, 0, s, 0, 40, 1) for s in (0, 2)], "read long, mate int, strand int, hit int, seq long, offset int, length int, occurrences long")
    reads = spark.createDataFrame([(1, "p", 50, "AC", None), (2, "q", 50, "AG", "T"), (3, "s", 50, None, None)], "read long, id string, query_length int, barcode string, UMI string")
    seqs = spark.createDataFrame([(0, "g0", 4), (1, "g1", 5), (2, "g2", 99)], "seq long, name string, tax_id long")
    got = {r.readID: (r.seqID, r.taxID, r.barcode, r.UMI, r.expandedTaxIDs) for r in C.classify(reads, hits, seqs, n, up, 1, expanded=True).collect()}
    assert got == {"p": ("genus", 3, "AC", "", "4,5"), "q": ("no rank", 1, "AG", "T", "1,4"), "s": ("unclassified", 0, "", "", "")}


def test_general_tree_and_names(spark, tree):
    n, up = tree
    more = n.unionByName(spark.createDataFrame([(50, 50, "species", "alone")], "tax_id long, parent_id long, rank string, name string"))
    assert {r.tax_id: r.parent_id for r in T.general_tree(more, 1).where("tax_id in (1, 50, 4)").collect()} == {1: 1, 50: 1, 4: 3}
    got = T.named_taxa(spark.createDataFrame([(4,), (99,)], "tax_id long"), n, 1).orderBy("tax_id").collect()
    assert [(r.known_id, r.name, r.rank) for r in got] == [(4, "x", "species"), (1, "Unknown", "no rank")]


def test_native_report_and_formats(spark, tree):
    n, up = tree
    counts = spark.createDataFrame([(1, 10.0, 1.0), (2, 9.0, 0.9), (3, 5.0, 0.5), (4, 5.0, 0.5), (8, 3.0, 0.3), (9, 2.0, 0.2), (6, 1e-9, 0.0)], "tax_id long, reads double, abundance double")
    lines = [r.value for r in sinks.native_lines(sinks.native_tree(counts, n, up)).collect()]
    assert lines == ["100.00\t10\t1\tR\t1\troot", "90.00\t9\t4\tD\t2\t  B", "50.00\t5\t0\tG\t3\t    G", "50.00\t5\t2\tS\t4\t      x", "30.00\t3\t1\tS1\t8\t        x8", "20.00\t2\t2\tS2\t9\t          x9"]
    report = spark.createDataFrame([("x", 4, "species", 100, 2, 1, 0.5, 2.0), ("root", 1, "no rank", 100, 3, 0, 1.0, 3.0)], "name string, taxID long, taxRank string, genomeSize long, numReads int, numUniqueReads int, abundance double, reads double")
    assert [r.value for r in sinks.report_lines(report, n, up, 1, "metaphlan").collect()] == [sinks.HEADERS["metaphlan"], "d__B|g__G|s__x\t2|3|4\t50.00000\t"]
    assert [r.value for r in sinks.report_lines(report, n, up, 1, "cami").collect()] == [sinks.HEADERS["cami"], "4\tspecies\t2|3|4\tB|G|x\t50.00000"]
    with pytest.warns(UserWarning, match="unknown report format"):
        odd = [r.value for r in sinks.report_lines(report, n, up, 1, "odd").collect()]
    assert odd == [sinks.HEADERS["default"], "root\t1\tno rank\t100\t3\t0\t" + odd[1].rsplit("\t", 1)[1], "x\t4\tspecies\t100\t2\t1\t" + odd[2].rsplit("\t", 1)[1]]
    assert [r.value.split("\t")[3] for r in sinks.report_lines(report, n, up, 1, "kreport").collect()] == ["R", "S"]
    rows = spark.createDataFrame([("p", 4), ("p", 5), ("q", 0)], "readID string, taxID long")
    assert sinks.processed_line(rows).first().value == "Processed 2 read fragments, and 1 (50.00%) can be classified."
    assert sinks.processed_line(rows.limit(0)).first().processed == 0


def test_maps_files_and_meta(spark, tree, tmp_path):
    n, up = tree
    raw = spark.createDataFrame([("d/one.fna.gz", 0, 0, "a", "ACGT" * 9), ("d/one.fna.gz", 0, 1, "b", "CCGT" * 9), ("d/two.fa", 1, 0, "a", "GGGT" * 9), ("d/two.fa", 1, 1, "t", "ACG")], "file string, file_no long, read_no long, id string, seq string")
    assert {r.seq_id: r.tax_id for r in P.header_map(raw.where("file_no = 0"), 7).collect()} == {"a": 7, "b": 7}
    assert [tuple(r) for r in P.file_map(raw.where("file_no = 1"), 7).collect()] == [("d/two.fa", 7)]
    files = spark.createDataFrame([("d/one.fna.gz", 4), ("d/two.fa", 5)], "file string, tax_id long")
    assert {r.seq_id: r.tax_id for r in P.file_header_map(raw, files).collect()} == {"a": 5, "b": 4, "t": 5}
    names = spark.createDataFrame([("one", 4)], "seq_id string, tax_id long")
    g = index.file_genomes(raw, names, up)
    assert sorted((r.seq, r.name, r.tax_id, r.read_no) for r in g.collect()) == [(0, "one", 4, 0), (0, "one", 4, 1), (1, "two", None, 0)]
    assert {r.name for r in index.file_genomes(raw, names, up, ignore_uncategorised=True).collect()} == {"one"}
    text = "".join(r.bases for r in sorted(search.genome_text(g).collect(), key=lambda r: r.start))
    assert text == "ACGT" * 9 + "CCGT" * 9 + "GGGT" * 9
    index.build(g, n, str(tmp_path / "i"))
    i = index.load(spark, str(tmp_path / "i"))
    assert not index.is_protein(i) and {r.name for r in index.seq_names(i).collect()} == {"one", "two"}
    assert {r.part: r.value for r in index.index_size(i).collect()} == {"letters": 108, "sequences": 2, "nodes": 4}
    assert spark.range(1).select(P.dna(F.lit("AUGu"))).first()[0] == "ATGt"


def test_tags_and_split_mates(spark, tmp_path):
    reads = spark.createDataFrame([(0, 0, "p", "ACGT", "IIII"), (0, 1, "q", "GGGG", "IIII")], "file_no int, read_no long, id string, seq string, qual string")
    none, some = read_format.parse("r1:0:1"), read_format.parse("r1:2:3,bc:0:1")
    assert "barcode" not in R.tagged(reads, none).columns
    cut = R.tagged(reads, some)
    assert sorted(r[0] for r in cut.select(read_format.extract(some["bc"], F.col("barcode"), F.lit(""))).collect()) == ["AC", "GG"]
    tags = spark.createDataFrame([(0, 0, "TT"), (0, 1, "CC")], "file_no int, read_no long, seq string")
    assert {r.id: r.barcode for r in R.tagged(reads, none, tags).collect()} == {"p": "TT", "q": "CC"}
    rows = spark.createDataFrame([("p", 4), ("q", 0)], "readID string, taxID long")
    both = reads.selectExpr("id", "seq", "qual", "seq as seq2", "cast(null as string) as qual2", "'T' as barcode")
    sinks.write_split_mates(both, rows, str(tmp_path / "c"), True)
    got = {s: [r.value for r in spark.read.text(str(tmp_path / f"c{s}")).collect()] for s in ("_1", "_2", "_bc")}
    assert got == {"_1": ["@p", "ACGT", "+", "IIII"], "_2": [">p", "ACGT"], "_bc": [">p", "T"]}
