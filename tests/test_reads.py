"""Read preparation, classification, index, sinks, database preparation and streaming on small inputs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import kernels, read_format
from taxaflow.operators import classify as C
from taxaflow.operators import prepare as P
from taxaflow.operators import reads as R
from taxaflow.operators import results, search
from taxaflow.operators import taxonomy as T
from taxaflow.sources import index, sinks
from taxaflow.streaming.classify import classify_stream

NODES = [(1, 1, "no rank", "root"), (2, 1, "superkingdom", "B"), (3, 2, "genus", "G"), (4, 3, "species", "x"), (5, 3, "species", "y"), (6, 3, "species", "z")]


def flip(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def test_low_complexity_against_all_intervals():
    rng = random.Random(4)
    seqs = ["", "AC", "A" * 30, "ACGT" * 3 + "N" * 70 + "CA" * 20, "".join(rng.choice("ACGT") for _ in range(90)), "".join(rng.choice("AC") for _ in range(80))]
    for s, got in zip(seqs, kernels.low_complexity(seqs), strict=True):
        words = [s[i : i + 3] for i in range(len(s) - 2)]
        score = {(i, j): sum(c * (c - 1) / 2 for c in Counter(words[i : j + 1]).values()) / (j - i) for i in range(len(words)) for j in range(i + 1, min(i + 62, len(words)))}
        best, want = {}, [False] * len(s)
        for i, j in sorted(score, key=lambda x: x[1] - x[0]):
            inside = max(best.get((i + 1, j), 0), best.get((i, j - 1), 0))
            if score[i, j] > 2 and score[i, j] >= inside:
                want[i : j + 3] = [True] * (j + 3 - i)
            best[i, j] = max(inside, score[i, j])
        assert got.tolist() == want


def test_dust_and_merge_columns(spark):
    rng = random.Random(5)
    whole = "".join(rng.choice("ACGT") for _ in range(160))
    rows = [
        (whole[:100], "I" * 100, flip(whole[60:]), "I" * 100),  # ends overlap
        (whole[:60] + "TTTTT", "I" * 65, flip(whole[:60]) + "CCCCC", "I" * 65),  # mates read through
        (whole[:60], None, flip(whole[100:]), None),  # apart
        ("A" * 40, "I" * 40, None, None),
        (None, None, None, None),
    ]
    got = spark.createDataFrame(rows, "r1 string, q1 string, r2 string, q2 string").select(kernels.merged_mates(*map(F.col, ("r1", "q1", "r2", "q2"))).alias("m"), kernels.dust(F.col("r1")).alias("d")).collect()
    assert [(r.m.kind, r.m.seq) for r in got] == [(1, whole), (2, whole[:60]), (0, None), (0, None), (0, None)]
    assert got[0].d == whole[:100] and got[3].d == "N" * 40 and got[4].d is None


def test_read_format(spark):
    f = read_format.parse("bc:0:3:-,r1:5:-1;r1:0:1,um:hd:UB=:3:-1")
    row = spark.createDataFrame([("AACCGGTN", "x CB=1 UB=ACG y"), ("AC", None)], "s string, c string")
    s, c = F.col("s"), F.col("c")
    got = row.select(read_format.extract(f["bc"], s, c), read_format.extract(f["r1"], s, c), read_format.extract(f["um"], s, c), read_format.extract(read_format.parse("um:hd:1:0:-1")["um"], s, c), read_format.extract(f["bc"], s, c, bases=False)).collect()
    assert [tuple(r) for r in got] == [("GGTT", "GTNAA", "ACG", "CB=1", "CCAA"), ("GT", "AC", "", "", "CA")]
    for bad in ("r3:0:1", "r1:0", "r1:a:1", "r1:0:1:x", "bc:hd::0:1"):
        with pytest.raises(ValueError):
            read_format.parse(bad)


def test_zip_and_barcodes(spark):
    reads = spark.createDataFrame([(0, i, f"s{i}") for i in range(4)], "file_no int, read_no long, seq string")
    one, two = R.split_interleaved(reads)
    assert [(r.read_no, r.r1.seq, r.r2.seq) for r in R.zip_records(r1=one, r2=two).orderBy("read_no").collect()] == [(0, "s0", "s1"), (1, "s2", "s3")]
    with pytest.raises(Exception, match="different numbers"):
        R.zip_records(r1=one, r2=two.where("read_no = 0")).collect()
    codes = spark.createDataFrame([(0, 0, "AAAA", "IIII"), (0, 1, "AAAC", "III#"), (0, 2, "CCCC", None), (0, 3, "GGGG", "IIII"), (0, 4, "AATT", "II#I"), (0, 5, None, None), (0, 6, "", "")], "file_no int, read_no long, barcode string, qual string")
    white = spark.createDataFrame([("AAAA",), ("CCCA",), ("AAGT",), ("AATG",), ("CCCG",), ("AAAA",)], "barcode string")
    counts = R.barcode_counts(white, codes)
    assert {r.barcode: r.n for r in counts.collect()} == {"AAAA": 2, "CCCA": 1, "AAGT": 1, "AATG": 1, "CCCG": 1}
    got = {r.read_no: r.corrected for r in R.correct_barcodes(codes, counts).collect()}
    assert got == {0: "AAAA", 1: "AAAA", 2: "CCCA", 3: "N", 4: "AAGT", 5: "N", 6: "N"}
    t = codes.where("read_no in (0, 6)").select(R.translate_barcode(F.col("barcode"), {"AA": "x", "CC": "y"}).alias("t"))
    assert {r.t for r in t.collect()} == {"x-x", ""}


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(3)]
    texts[2] = texts[1][:200] + texts[2][200:]  # y and z share their first half
    n = spark.createDataFrame(NODES, "tax_id long, parent_id long, rank string, name string")
    genomes = spark.createDataFrame([(i, f"g{i}", 4 + i, t) for i, t in enumerate(texts)], "seq long, name string, tax_id long, bases string")
    return texts, n, T.closure(n).persist(), genomes


def test_classification_end_to_end(spark, world):
    texts, n, up, genomes = world
    reads = [texts[0][10:110], flip(texts[0][50:150]), texts[1][20:120], texts[1][250:300] + "N" + texts[1][301:351], "A" * 50, None]
    df = spark.createDataFrame([(i, f"r{i}", s, len(s or "")) for i, s in enumerate(reads)], "read long, id string, seq string, query_length int")
    hits = search.search(df.select("read", "seq"), search.genome_text(genomes.select("seq", "bases")), 23).withColumn("mate", F.lit(1))
    out = {r.readID: r for r in C.classify(df, hits, genomes, n, up, 1).collect()}
    assert len(out) == 6
    assert tuple(out["r0"])[1:] == ("g0", 4, 85**2, 0, 100, 100, 1) and tuple(out["r1"])[1:] == ("g0", 4, 85**2, 0, 100, 100, 1)
    assert tuple(out["r2"])[1:] == ("genus", 3, 85**2, 85**2, 100, 100, 1)  # a tie of two species
    assert tuple(out["r3"])[1:] == ("g1", 5, 85**2, 0, 100, 101, 1)  # two hits around N, one base apart, are one
    assert tuple(out["r4"])[1:] == ("unclassified", 0, 0, 0, 0, 50, 1)
    two = C.classify(df, hits, genomes, n, up, 1, k=2).where("readID = 'r2'").collect()
    assert sorted((r.seqID, r.taxID, r.numMatches) for r in two) == [("g1", 5, 2), ("g2", 6, 2)]


def test_strands_and_near_ties(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0, 7, 0, 40, 1), (1, 2, -1, 0, 7, 0, 40, 1), (1, 1, -1, 0, 8, 0, 40, 1), (2, 1, 1, 0, 7, 0, 30, 1), (2, 1, -1, 0, 8, 0, 30, 1)], "read long, mate int, strand int, hit int, seq long, offset int, length int, occurrences long")
    got = C.choose_strand(hits)
    assert sorted((r.read, r.seq, r.mate, r.mixed) for r in got.collect()) == [(1, 7, 1, False), (1, 7, 2, False), (2, 7, 1, True), (2, 8, 1, True)]
    scores = spark.createDataFrame([(1, 1, 5, 1000, 2500), (1, 1, 6, 996, 2500), (1, -1, 9, 10, 3), (2, 1, 5, 1000, 100), (2, 1, 6, 996, 100)], "read long, pool int, seq long, score long, hit_length long")
    assert sorted((r.read, r.seq, r.score, r.second, r.n) for r in C.best_sequences(scores).collect()) == [(1, 5, 1000, 996, 2), (1, 6, 1000, 996, 2), (2, 5, 1000, 996, 1)]


def test_index_and_sinks(spark, world, tmp_path):
    texts, n, up, _ = world
    raw = spark.createDataFrame([(0, 0, "a", texts[0]), (0, 1, "a", "dropped"), (0, 2, "b", texts[1]), (1, 0, "c", texts[2]), (1, 1, "u", "ACGT" * 9), (1, 2, "tiny", "ACGTacgtt")], "file_no int, read_no long, id string, seq string")
    known = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "seq_id string, tax_id long")
    g = index.usable_genomes(raw, known, up)
    assert sorted((r.seq, r.name, r.tax_id) for r in g.collect()) == [(0, "a", 4), (1, "b", 5), (2, "c", 6), (3, "u", None), (4, "tiny", None)]
    assert {r.name for r in index.usable_genomes(raw, known, up, within=5).collect()} == {"b"}
    assert {r.name for r in index.usable_genomes(raw, known, up, ignore_uncategorised=True).collect()} == {"a", "b", "c"}
    index.build(g, n, str(tmp_path / "i"))
    i = index.load(spark, str(tmp_path / "i"))
    assert sorted((r.name, r.length, r.taxon) for r in index.summary(i).collect()) == [("a", 400, "x"), ("b", 400, "y"), ("c", 400, "z"), ("u", 36, "Unknown")]
    assert {r.tax_id: r.length for r in index.size_table(i).collect()} == dict.fromkeys(range(1, 7), 400)
    rows = spark.createDataFrame([("p", 4), ("q", 4), ("r", 5), ("s", 0)], "readID string, taxID long")
    sinks.write_split_reads(spark.createDataFrame([("p", "AC", "II"), ("s", "GG", None)], "id string, seq string, qual string"), rows, str(tmp_path / "c"), str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u")).collect()] == [">s", "GG"] and spark.read.text(str(tmp_path / "c")).count() == 4
    tree = sinks.clade_tree(results.clade_report(rows.where("taxID <> 0"), n, up, 1), n, up)
    assert [r.value.split("\t")[1:] for r in sinks.clade_lines(tree).collect()] == [["3", "0", "-", "1", "root"], ["3", "0", "D", "2", "  B"], ["3", "0", "G", "3", "    G"], ["2", "2", "S", "4", "      x"], ["1", "1", "S", "5", "      y"]]
    report = spark.createDataFrame([(4, "species", 2, 0.5), (1, "no rank", 3, 1.0)], "taxID long, taxRank string, numReads int, abundance double")
    lines = sinks.lineage_of(n, up, 1)
    assert [r.value for r in sinks.metaphlan(report, lines).collect()] == ["d__B|g__G|s__x\t2|3|4\t50.00000\t"]
    assert [r.value for r in sinks.cami(report, lines).collect()] == ["4\tspecies\t2|3|4\tB|G|x\t50.00000"]


def test_prepare(spark):
    line = "\t".join(["x"] * 4 + ["reference genome", "7", "6"] + ["x"] * 3 + ["latest", "Complete Genome"] + ["x"] * 7 + ["ftp://h/a/GCF_1", "na"])
    got = P.choose_assemblies(spark.createDataFrame([("# head",), (line,), (line.replace("latest", "replaced"),)], "value string"), level="Complete").withColumn("f", P.sequence_file(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(7, 6, "ftp://h/a/GCF_1", "ftp://h/a/GCF_1/GCF_1_genomic.fna.gz")]
    lines = ["ID   1", "DE   one thing", "SQ   x", "     acgt acgt 8", "     ttt 11", "//", "DE   two", "     gg 2", "//"]
    got = P.embl_to_fasta(spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no long, value string")).orderBy("record").collect()
    assert [(r.header, r.seq) for r in got] == [("one thing", "ACGTACGTTTT"), ("two", "GG")]
    table = spark.createDataFrame([("A1", "A1.1", 9), ("B1", "B1.2", 8)], "accession string, version string, taxid long")
    assert {r.accession: r.taxid for r in P.taxids_of(spark.createDataFrame([("A1.5",), ("Z.1",)], "accession string"), table).collect()} == {"A1.5": 9, "Z.1": 1}
    assert [r.version for r in P.known_accessions(table, spark.createDataFrame([("B1.2",)], "id string")).collect()] == ["B1.2"]
    assert spark.range(1).select(P.genome_path(F.lit("RS_GCF_000657795.2"))).first()[0] == "GCF/000/657/795/GCF_000657795.2_genomic.fna.gz"
    tree = P.tree_from_lineages(spark.createDataFrame([(0, "d__A;p__B"), (1, "d__A;p__C"), (2, "d__D;p__E")], "row_no long, lineage string"), spark.createDataFrame([("C", 77)], "name string, tax_id long"))
    assert sorted((r.tax_id, r.parent_id, r.rank, r.name) for r in tree.collect()) == [(77, 10000000, "phylum", "C"), (10000000, 1, "domain", "A"), (10000001, 10000000, "phylum", "B"), (10000002, 1, "domain", "D"), (10000003, 10000002, "phylum", "E")]
    with pytest.raises(Exception, match="two parents"):
        P.tree_from_lineages(spark.createDataFrame([(0, "d__A;p__B"), (1, "d__D;p__B")], "row_no long, lineage string")).collect()
    paths = P.tree_from_paths(spark.createDataFrame([(0, "A;", 5, "domain"), (1, "A;B;", 6, "phylum"), (2, "Q;Z;", 7, "phylum")], "row_no long, path string, tax_id long, rank string"))
    assert sorted((r.tax_id, r.parent_id, r.name) for r in paths.collect()) == [(5, 1, "A"), (6, 5, "B"), (7, 1, "Z")]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "ACGT"), (2, "GG")], "read long, seq string").write.parquet(src)
    q = classify_stream(spark.readStream.schema("read long, seq string").parquet(src), lambda b: b.select("read", F.length("seq").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert sorted((r.read, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 4), (2, 2)]


def test_report_of_unclassified_reads_zeros_and_scores(spark):
    n = spark.createDataFrame(NODES, "tax_id long, parent_id long, rank string, name string")
    up = T.closure(n).persist()
    rows = spark.createDataFrame([("p", 4, 90, 0), ("q", 4, 40, 0), ("q", 5, 70, 1), ("r", 0, 8, 0), ("s", 99, 5, 0), ("t", 0, 0, 0), ("t", 5, 0, 1), ("u", 0, 0, 0)], "readID string, taxID long, score long, row_no long")
    report = results.clade_report(rows, n, up, 1)
    assert {r.tax_id: (r.clade_reads, r.own_reads, round(r.percent, 2)) for r in report.collect()} == {0: (2, 2, 33.33), 1: (4, 1, 66.67), 2: (3, 0, 50), 3: (3, 1, 50), 4: (1, 1, 16.67), 5: (1, 1, 16.67)}
    shared = results.clade_report(rows, n, up, 1, with_lca=False)
    assert {r.tax_id: r.own_reads for r in shared.collect()} == {0: 2.5, 1: 1, 2: 0, 3: 0, 4: 1.5, 5: 1}
    full = results.clade_report(rows, n, up, 1, zeros=True, scores=True)
    lines = [r.value.split("\t") for r in sinks.clade_lines(sinks.clade_tree(full, n, up)).collect()]
    assert lines[0] == [" 33.33", "2", "2", "U", "0", "unclassified", "0"]
    assert [(x[1], x[3], x[4], x[6]) for x in lines[1:]] == [("4", "-", "1", "90"), ("3", "D", "2", "90"), ("3", "G", "3", "90"), ("1", "S", "4", "90"), ("1", "S", "5", "0"), ("0", "S", "6", "0")]
    assert {r.score for r in results.clade_report(rows, n, up, 1, with_lca=False, scores=True).collect()} == {0}
    some = sinks.clade_tree(results.clade_report(rows.where("readID = 'p'"), n, up, 1), n, up)
    assert [r.value.split("\t")[1:] for r in sinks.clade_lines(some, unclassified=True).collect()][0] == ["0", "0", "U", "0", "unclassified"]
    assert sinks.clade_lines(some).count() == 4 and sinks.clade_lines(sinks.clade_tree(report, n, up), unclassified=True).count() == 6


def test_masks_and_segments_over_documents(spark, tmp_path):
    from taxaflow.plans import queries as Q

    rng = random.Random(7)
    letters = "abcdefghijkl"
    texts = ["a" * 60, None, "", "ab", "".join(rng.choice(letters) for _ in range(200_000)), "one two three four five"] + ["".join(rng.choice(letters) for _ in range(30_000)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    masks = {r.doc_id: r.md5 for r in Q.QUERIES["document_masks"](spark, str(tmp_path)).collect()}
    alone = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", Q._dna("text").alias("s")).collect()
    for r in alone:
        mask = next(kernels.low_complexity([r.s or ""]))
        want = None if r.s is None else hashlib.md5("".join("N" if m else c for c, m in zip(r.s, mask, strict=True)).encode()).hexdigest()
        assert masks[r.doc_id] == want
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.sql(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, Q.QUERIES["document_segments"](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(Q.SQL["document_segments"]).fetchall())
