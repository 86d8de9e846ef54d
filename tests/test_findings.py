"""Cases that once failed: results that differed from SQL, and inputs larger than the driver."""

import random

import duckdb
import pytest

from taxaflow.operators import classify, results, search
from taxaflow.operators import taxonomy as T
from taxaflow.plans import queries as Q


def line_items(spark, folder, rows):
    """A lineitem table of (order, supplier, line, quantity, price, tax)."""
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


def test_coalesced_assignments_round_scores_as_their_sql_does(spark, tmp_path):
    # 50000.61 beats a second score of 50000 only once rounded; 30000.5 goes to the even 30000; 9.5 bases are 10
    line_items(spark, tmp_path, [(1, 1, 1, 49.0, 50000.61, 0.05), (2, 2, 1, 50.0, 30000.5, 0.03), (3, 3, 1, 9.5, 900.0, 0.0), (4, 1, 2, 48.5, 50000.4, 0.05)])
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(Q.SQL["coalesced_assignments"]).fetchall())
    got = sorted(tuple(r) for r in Q.coalesced_assignments(spark, str(tmp_path)).collect())
    assert got == want
    assert {r[0]: r[3] for r in got} == {"10000001": 1.0, "10000002": 0.0, "10000003": 1.0}


def test_a_text_in_blocks_gives_the_hits_of_one_suffix_array(spark):
    rng = random.Random(5)

    def dna(n):
        return "".join(rng.choices("ACGT", k=n))

    common, read = dna(40), dna(90)
    bases = [dna(30) + read[i % 7 * 9 : i % 7 * 9 + 30] + common + "ACG" * (i % 3) + dna(rng.randint(0, 20)) for i in range(50)]
    bases += [bases[3], "ACGT", common + bases[3], read + dna(5), bases[0][:60]] + [common * 2] * 3
    genomes = spark.createDataFrame(list(enumerate(bases)), "seq long, bases string").repartition(3)
    text = search.genome_text(genomes)
    parts = sorted(text.collect(), key=lambda r: r.start)
    whole = search.Index("".join(r.bases for r in parts).encode(), [r.start for r in parts], [r.seq for r in parts])
    reads = [read, common[5:], common + read[::-1], "N".join([read[:50], read[50:], common]), bases[7][10:] + bases[9][:60], "", "ACGT", None, dna(200), common.translate(str.maketrans("ACGT", "TGCA"))[::-1]]
    for block, most, agree in ((150, 40, True), (1 << 20, 3, False)):
        want = sorted((i, *h) for i, r in enumerate(reads) for h in whole.hits(r or "", 23, most, agree=agree))
        got = sorted(tuple(r) for r in search.search(spark.createDataFrame(list(enumerate(reads)), "read long, seq string"), text, 23, factor=most, agree=agree, block=block).collect())
        assert got == want
        assert max(h[-1] for h in got) > 40


def test_classified_reads_hold_no_index_of_the_text(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise MemoryError("an index of the whole text")

    monkeypatch.setattr(search, "suffix_array", refused)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh", k=300)) for _ in range(4)]
    spark.createDataFrame([*enumerate(texts), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, texts[2][50:150]), (1, "ab")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"n{i}", 1) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "s", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.readID: (r.seqID, r.taxID, r.score, r.hitLength) for r in Q.classified_reads(spark, str(tmp_path)).collect()}
    assert got == {"0": ("2", 102, 85 * 85, 100), "1": ("unclassified", 0, 0, 0)}


def test_the_plan_of_classified_reads_names_no_step_again_and_again(spark):
    hits = spark.createDataFrame([(r, 1, 1, 0, s, 0, 30 + s, 2) for r in range(3) for s in range(r + 1)], search.HITS.replace("strand", "mate int, strand", 1)).repartition(2)
    reads = spark.createDataFrame([(r, f"r{r}", 50) for r in range(4)], "read long, id string, query_length int")
    sequences = spark.createDataFrame([(s, f"s{s}", 2 + s % 2) for s in range(3)], "seq long, name string, tax_id long")
    nodes = spark.createDataFrame([(1, 1, "no rank", "r"), (2, 1, "genus", "g"), (3, 1, "genus", "h")], "tax_id long, parent_id long, rank string, name string")
    out = classify.classify(reads, hits, sequences, nodes, T.closure(nodes), 1)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert len(plan.splitlines()) < 60 and plan.count("Window") < 10
    assert sorted((r.readID, r.seqID, r.taxID, r.numMatches) for r in out.collect()) == [("r0", "s0", 2, 1), ("r1", "s1", 3, 1), ("r2", "s2", 2, 1), ("r3", "unclassified", 0, 1)]


def test_abundances_of_more_sets_than_the_driver_holds(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(1, 1, "no rank", "r"), *((i, 1, "genus", f"g{i}") for i in range(2, 6)), *((i, 2 + i % 4, "species", f"s{i}") for i in range(10, 30))], "tax_id long, parent_id long, rank string, name string")
    up = T.closure(nodes)
    sets = [(rng.sample([*range(10, 30), 3, 99], rng.randint(1, 4)), rng.random()) for _ in range(60)]
    assigned = spark.createDataFrame(sets, "targets array<long>, weight double").repartition(3)
    lengths = spark.createDataFrame([(i, 1000 * i) for i in range(10, 28)], "tax_id long, length long")
    few = results.abundances(assigned, nodes, up, lengths, 1, most=5)
    many = results.abundances(assigned, nodes, up, lengths, 1, most=5, most_rows=59)
    assert few == pytest.approx(many, rel=1e-12)
    assert few[1] > 0 and len(few) == len({99, 1, *range(2, 30)} - set(range(6, 10)) - {99})
