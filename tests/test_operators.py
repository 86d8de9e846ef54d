"""Sequence operators on small inputs and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import sequence as S
from taxaflow.operators import results as R
from taxaflow.operators import search as X
from taxaflow.operators import taxonomy as T
from taxaflow.sources import tables

NODES = [(1, 1, "no rank", "root"), (2, 1, "superkingdom", "B"), (3, 2, "phylum", "P"), (4, 3, "genus", "G"), (5, 4, "species", "a"), (6, 4, "species", "b"), (7, 3, "species", "c"), (8, 6, "strain", "b1")]


@pytest.fixture(scope="module")
def tree(spark):
    n = spark.createDataFrame(NODES, "tax_id long, parent_id long, rank string, name string")
    return n, T.closure(n).persist()


def path(x):
    parent = {a: b for a, b, *_ in NODES}
    out = [x]
    while parent[out[-1]] != out[-1]:
        out.append(parent[out[-1]])
    return out


def test_closure_lca_and_reduction(spark, tree):
    n, up = tree
    assert sorted((r.tax_id, r.anc, r.depth) for r in up.collect()) == sorted((a, x, d) for a, *_ in NODES for d, x in enumerate(path(a)))
    rng = random.Random(1)
    reads = {i: [rng.choice(range(1, 9)) for _ in range(rng.randint(1, 4))] for i in range(60)}
    t = spark.createDataFrame([(i, x) for i, xs in reads.items() for x in xs], "read long, tax_id long")
    want = {}
    for i, xs in reads.items():
        below = [x for x in xs if x != 1]
        shared = set.intersection(*(set(path(x)) for x in below)) if below else {1}
        want[i] = max(shared, key=lambda x: len(path(x)))
    assert {r.read: r.lca for r in T.lca(t, up, 1).collect()} == want
    two = {}
    rows = [(1, 5), (1, 8), (1, 7), (2, 5), (3, 5), (3, 99), (4, 5), (4, 99), (4, 7), (5, 1), (5, 3), (6, 8), (6, 5), (6, 6), (7, 1), (7, 2), (7, 5)]
    for r in T.reduce_to_k(spark.createDataFrame(rows, "read long, tax_id long"), n, up, 1, 2).collect():
        two.setdefault(r.read, set()).add(r.tax_id)
    # 1: species 5, 6, 7, then genus 4 and, for 7, its phylum; 7: the root stands for no level
    assert two == {1: {3, 4}, 2: {5}, 3: {5, 99}, 4: {None}, 5: {1, 3}, 6: {5, 6}, 7: {2, 5}}
    assert {r.tax_id: r.lineage for r in T.lineage(up, n, 1).collect()}[8] == "B|P|G|b|b1"
    assert {r.tax_id for r in T.subtree(n, up, 4).collect()} == {4, 5, 6, 8}
    assert {(r.read, r.tax_id) for r in T.promote(t.limit(0).unionByName(spark.createDataFrame([(1, 8), (1, 6), (1, 7)], "read long, tax_id long")), n, up, "genus").collect()} == {(1, 4), (1, 7)}


def test_lengths(spark, tree):
    s = spark.createDataFrame([("NC_0010.1", 5, 10), ("NC_0011.1", 5, 20), ("NC_0020.1", 5, 25), ("x", 7, 8)], "name string, tax_id long, length long")
    assert {r.tax_id: r.length for r in T.infer_lengths(T.taxon_lengths(s), tree[1]).collect()} == {5: 30, 7: 8, 4: 30, 3: 19, 2: 19, 1: 19}
    # neighbours in the order of all names: another taxon's sequence lies between, however many ranges there are
    s = spark.createDataFrame([("NC_0010", 5, 10), ("NM_0001", 7, 1), ("NZ_0011", 5, 20), ("NZ_0012", 5, 3), ("ab_99999999999999999999", 5, 2)], "name string, tax_id long, length long")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.tax_id: r.length for r in T.taxon_lengths(s).collect()} == {5: 23, 7: 1}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    # a sized inner node counts for itself, not for those above; a size table keeps what it gives
    own = spark.createDataFrame([(5, 100), (4, 700), (6, 900), (8, 300)], "tax_id long, length long")
    assert {r.tax_id: r.length for r in T.infer_lengths(own, tree[1]).collect()} == {5: 100, 8: 300, 6: 600, 4: 366, 3: 200, 2: 200, 1: 200}
    assert {r.tax_id: r.length for r in T.infer_lengths(own, tree[1], given=True).collect()} == {5: 100, 8: 300, 6: 900, 4: 700, 3: 200, 2: 200, 1: 200}


def test_reads_outside_the_tree_count_for_the_root(spark, tree):
    n, up = tree
    rows = spark.createDataFrame([(1, 5, 9, 0, 50, 50, 1), (2, 99, 9, 0, 50, 50, 2), (3, 99, 9, 9, 50, 50, 3), (3, 6, 9, 9, 50, 50, 4)], "readID long, taxID long, score long, `2ndBestScore` long, hitLength int, queryLength int, row_no long")
    lengths = spark.createDataFrame([(5, 100)], "tax_id long, length long")
    got = {r.taxID: (r.numReads, r.numUniqueReads) for r in R.quant_report(rows, n, up, lengths, 1).collect()}
    assert got == {1: (3, 2), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1), 6: (0, 0)}


def test_clade_report_of_rows_and_counts(spark, tree):
    n, up = tree
    rows = spark.createDataFrame([(1, 5, 2, 40, 30), (1, 6, 2, 40, 30), (2, 0, 1, 0, 0), (3, 7, 3, 9, 30), (4, 5, 1, 50, 20)], "readID long, taxID long, numMatches int, score long, hitLength int")
    shared = {r.tax_id: (r.clade_reads, r.own_reads) for r in R.clade_report(rows, n, up, 1, with_lca=False).collect()}
    assert shared[5] == (1.5, 1.5) and shared[6] == (0.5, 0.5) and shared[0] == (1, 1) and abs(shared[1][0] - (2 + 1 / 3)) < 1e-9
    some = {r.tax_id: r.clade_reads for r in R.clade_report(rows, n, up, 1, least_score=10, least_length=25).collect()}
    assert some == {4: 1, 3: 1, 2: 1, 1: 1}
    counts = spark.createDataFrame([(5, 9.0, 0), (5, 3.0, 1), (0, 2.0, 2), (99, 6.0, 3), (4, 5.0, 4)], "tax_id long, count double, row_no long")
    got = {r.tax_id: (r.clade_reads, r.own_reads, round(r.percent, 3)) for r in R.clade_report_of_counts(counts, n, up, 1).collect()}
    assert got == {0: (2, 2, 8.0), 5: (3, 3, 12.0), 4: (8, 5, 32.0), 3: (8, 0, 32.0), 2: (8, 0, 32.0), 1: (8, 0, 32.0)}


def test_golden_rows_give_the_derived_abundances(spark):
    nodes = [(1, 1), (131567, 1), (2, 131567), (1224, 2), (1236, 1224), (118969, 1236), (444, 118969), (445, 444), (446, 445), (297246, 446), (91891, 446), (272624, 91891)]
    n = spark.createDataFrame([(a, b, "no rank", str(a)) for a, b in nodes], "tax_id long, parent_id long, rank string, name string")
    up = T.closure(n).persist()
    lengths = T.infer_lengths(spark.createDataFrame([(272624, 3397753), (297246, 3503503)], "tax_id long, length long"), up)
    # coalesced weights of the published example: FIXTURES.md, section C
    a = spark.createDataFrame([([297246], 16.380150, 48.0, 48.0), ([272624], 10.257840, 48.0, 48.0), ([446], 1.000001, 4.0, 0.0)], "targets array<long>, weight double, cnt double, uniq double")
    got = R.abundances(a, n, up, lengths, 1)
    assert abs(got[272624] - 0.3917015) < 2e-6 and abs(got[297246] - 0.6082985) < 2e-6 and abs(got[446] - 1) < 1e-6


def test_columns(spark):
    r = spark.createDataFrame([("ACGTTX", "ATGTAANN", 100, 182)], "a string, b string, h int, q int").select(S.reverse_complement(F.col("a")).alias("rc"), S.translate_frame(F.col("b"), 0).alias("aa"), S.assignment_weight(F.col("h"), F.lit(103)).alias("w"), S.hit_score(F.lit(22)).alias("z"), S.hit_score(F.lit(30)).alias("s")).first()
    assert tuple(r) == ("NAACGT", "M_", 0.0625, 0, 225)
    assert S.least_hit_length(1_844_909) == 23 and S.size_of("2K") == 2000


def test_search_finds_longest_suffixes(spark):
    rng = random.Random(2)
    text = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 200, 5, 150)]
    g = spark.createDataFrame(list(enumerate(text)), "seq long, bases string")
    t = X.genome_text(g)
    assert [(r.seq, r.start) for r in sorted(t.collect(), key=lambda r: r.seq)] == [(0, 0), (1, 300), (3, 500)]
    whole = text[0] + text[1] + text[3]
    reads = [whole[i : i + 40] + rng.choice("ACGT") + whole[j : j + 40] for i, j in ((10, 350), (100, 520), (290, 0))]
    got = X.search(spark.createDataFrame(list(enumerate(reads)), "read long, seq string"), t, 23).where("strand = 1").collect()
    for k, read in enumerate(reads):
        end, want = len(read), []
        while end >= 23:
            n = max(m for m in range(end + 1) if read[end - m : end] in whole)
            if n >= 23:
                want.append((len(read) - end, n))
            end -= (n if n >= 10 else 9) + 1
        assert sorted({(r.offset, r.length) for r in got if r.read == k}) == sorted(want)


def test_readers(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n5\t|\t1\t|\tspecies\t|\n5\t|\t9\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("5\t|\tx y\t|\t\t|\tsynonym\t|\n5\t|\tLong name\t|\t\t|\tscientific name\t|\n")
    assert sorted(tuple(r) for r in tables.nodes_dmp(spark, str(tmp_path / "nodes.dmp")).collect()) == [(1, 1, "no rank"), (5, 1, "species")]
    assert [tuple(r) for r in tables.names_dmp(spark, str(tmp_path / "names.dmp")).collect()] == [(5, "Long_name")]
    (tmp_path / "r.fq").write_text("@a/1\tc x\nAC\nGT\n+\n@@\nII\n@b\nAA\n+\nII\n>f\nACG\nT\n@bad\nACG\n+\nI\n")
    assert [tuple(r)[2:] for r in tables.fastx(spark, str(tmp_path / "r.fq")).collect()] == [(0, "a", "c x", "ACGT", "@@II"), (1, "b", "", "AA", "II"), (2, "f", "", "ACGT", None)]
    (tmp_path / "sizes").write_text("5 10\n6 7\n5\t12\n")
    assert sorted(map(tuple, tables.size_table(spark, str(tmp_path / "sizes")).collect())) == [(5, 12), (6, 7)]
    (tmp_path / "sheet").write_text("a_1.fq\ta_2.fq . . a.tsv\nb.fq . bc.fq . b.tsv\n")
    assert [tuple(r) for r in tables.sample_sheet(spark, str(tmp_path / "sheet")).collect()] == [(0, "a_1.fq", "a_2.fq", None, None, "a.tsv"), (1, "b.fq", None, "bc.fq", None, "b.tsv")]
    (tmp_path / "list").write_text("x.fa 5\ny.fa\n")
    assert [tuple(r) for r in tables.genome_list(spark, str(tmp_path / "list")).collect()] == [(0, "x.fa", 5), (1, "y.fa", None)]
    (tmp_path / "counts").write_text("5 1.5\n0\t2\n")
    assert [tuple(r)[:2] for r in tables.count_table(spark, str(tmp_path / "counts")).collect()] == [(5, 1.5), (0, 2.0)]


def test_closure_of_a_tall_tree_or_a_cycle(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 1)) for i in range(1, 6)], "tax_id long, parent_id long")  # 4 steps
    assert T.closure(chain, most=3).count() == 15 and T.closure(chain.where("tax_id < 5"), most=2).count() == 10
    with pytest.raises(RuntimeError, match="4 steps"):
        T.closure(chain, most=2)
    with pytest.raises(RuntimeError, match="cycle"):
        T.closure(spark.createDataFrame([(2, 3), (3, 2)], "tax_id long, parent_id long"), most=2)


def test_bench_times_every_query(spark, monkeypatch, capsys):
    import json

    import bench

    names = ["pipeline", "read_search", "classified_reads", "tax_lca"]
    monkeypatch.setenv("BENCH_CPUS", "4")
    monkeypatch.setattr(bench.entry, "queries", lambda: {n: lambda s, d: s.range(1) for n in names})
    bench.main()
    assert list(json.loads(capsys.readouterr().out)["queries"]) == names
