"""Classification results: from hits to assignments, reports and abundances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.sequence import assignment_weight, hit_score
from taxaflow.operators import taxonomy as T
from taxaflow.storage import stored


def score_hits(hits: DataFrame, least: int = 23, adjust: int = 15) -> DataFrame:
    """(read, strand, seq, score, hit_length) from (read, strand, hit, seq, length): a sequence counts once for each hit."""
    one = hits.where(F.col("length") >= least).groupBy("read", "strand", "hit", "seq").agg(F.max("length").alias("length"))
    return one.groupBy("read", "strand", "seq").agg(F.sum(hit_score(F.col("length"), least, adjust)).alias("score"), F.sum("length").alias("hit_length"))


def best_hits(scores: DataFrame) -> DataFrame:
    """(read, seq, score, second, n): sequences of the best score; second is the next score, or the best itself on a tie."""
    top = scores.groupBy("read", "seq").agg(F.max("score").alias("score"))
    w = W.partitionBy("read")
    ranked = top.withColumn("r", F.rank().over(w.orderBy(F.desc("score"))))
    ranked = ranked.withColumn("n", F.count_if(F.col("r") == 1).over(w)).withColumn("next", F.max(F.when(F.col("r") > 1, F.col("score"))).over(w))
    return ranked.where("r = 1").select("read", "seq", "score", F.when(F.col("n") > 1, F.col("score")).otherwise(F.coalesce("next", F.lit(0))).alias("second"), "n")


def assignments(rows: DataFrame, least_score: int = 0, least_length: int = 0) -> DataFrame:
    """(targets, weight, cnt, uniq): reads grouped and coalesced by their ordered targets. rows: readID, taxID, score, 2ndBestScore, hitLength, queryLength, row_no."""
    ok = rows.where((F.col("hitLength") >= least_length) & (F.col("score") >= least_score) & (F.col("taxID") != 0))
    first = F.min(F.struct("row_no", "taxID", "score", F.col("2ndBestScore").alias("second"), "hitLength", "queryLength"))
    reads = ok.groupBy("readID").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "taxID"))), lambda x: x["taxID"]).alias("targets"), first.alias("f"))
    weight = assignment_weight(F.col("f.hitLength"), F.col("f.queryLength"))
    return reads.groupBy("targets").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).cast("double").alias("cnt"), F.sum((F.col("f.score") > F.col("f.second")).cast("double")).alias("uniq"))


def split_counts(assigned: DataFrame) -> DataFrame:
    """(tax_id, reads, uniq): a read's count is shared by its targets; unique reads count for each."""
    return assigned.select(F.explode("targets").alias("tax_id"), (F.col("cnt") / F.size("targets")).alias("reads"), "uniq").groupBy("tax_id").agg(F.sum("reads").alias("reads"), F.sum("uniq").alias("uniq"))


def read_counts(assigned: DataFrame, nodes: DataFrame, up: DataFrame, root: int) -> DataFrame:
    """(tax_id, reads, uniq) of clades; a target outside the tree counts for the root."""
    here = nodes.select("tax_id", F.lit(True).alias("there"))
    own = split_counts(assigned).join(here, "tax_id", "left").select(F.when(F.col("there"), F.col("tax_id")).otherwise(F.lit(root)).alias("tax_id"), "reads", "uniq")
    return T.roll_up(own, up, "reads", "uniq")


def abundances(assigned: DataFrame, nodes: DataFrame, up: DataFrame, lengths: DataFrame, root: int, most: int = 1000, most_rows: int = 2_000_000) -> dict[int, float]:
    """Abundance of each covered taxon, by expectation maximisation over the coalesced assignments and the tree.

    Coalescing leaves one row for each set of targets. Up to most_rows of them are collected, packed; more stay on the
    executors, where every round is one pass over them. The driver holds the covered taxa.
    """
    covered = assigned.select(F.explode("targets").alias("tax_id")).distinct().join(up, "tax_id").select("anc").distinct()
    tree = {r["tax_id"]: r["parent_id"] for r in nodes.join(covered.withColumnRenamed("anc", "tax_id"), "tax_id", "left_semi").select("tax_id", "parent_id").collect()}
    size = {r["tax_id"]: r["length"] for r in lengths.join(covered.withColumnRenamed("anc", "tax_id"), "tax_id", "left_semi").collect()}
    if assigned.isEmpty():
        return {}
    deep = {root: 0}

    def depth(x: int) -> int:
        path = []
        while x not in deep:
            path.append(x)
            p = tree.get(x, root)
            x = p if p != x else root
        d = deep[x]
        for y in reversed(path):
            d += 1
            deep[y] = d
        return d

    ids = sorted(set(tree) | {root}, key=lambda x: (depth(x), x))
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    parent = np.array([at[root] if x == root or tree.get(x, x) == x else at[tree[x]] for x in ids])
    by_depth = [np.flatnonzero(np.array([deep[x] for x in ids]) == d) for d in range(1, max(deep[x] for x in ids) + 1)]
    length = np.array([float(size.get(x, 1_000_000)) for x in ids])
    length = length + length[at[root]] // 10
    shares = _shares(assigned, at, at[root], n, most_rows)

    def rolled(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for level in reversed(by_depth):
            np.add.at(x, parent[level], x[level])
        return x

    def spread(x: np.ndarray, per: np.ndarray) -> np.ndarray:
        """What a node holds beyond its children goes to them by abundance per length, top down."""
        x = x.copy()
        for level in by_depth:
            below = np.bincount(parent[level], x[level], n)
            share = x[level] / per[level]
            total = np.bincount(parent[level], share, n)
            excess = np.maximum(0, x - below)
            more = total[parent[level]] > 0
            x[level[more]] += excess[parent[level[more]]] * share[more] / total[parent[level[more]]]
        return x

    a = spread(rolled(shares(np.zeros(n))), length)
    a /= a[at[root]] or 1.0
    for _ in range(most):
        count = shares(a) / length
        new = spread(rolled(count / (count.sum() or 1.0)), np.ones(n))
        delta = np.abs(new - a).sum()
        a = new
        if delta < 1e-6 and delta < 0.1 / n:
            break
    return {x: float(v) for x, v in zip(ids, a, strict=True)}


def _shares(assigned: DataFrame, at: dict[int, int], other: int, n: int, most_rows: int, slice_: int = 1 << 16) -> Callable[[np.ndarray], np.ndarray]:
    """What each of n taxa gets of all weights, by given abundances: a set's weight is shared by those of its targets, evenly if they have none. at: places of taxa; others are at `other`."""
    spark = assigned.sparkSession
    taxa = np.array(sorted(at), np.int64)
    known = spark.sparkContext.broadcast((taxa, np.array([at[x] for x in taxa.tolist()], np.int64)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taxa, places = known.value
        for batch in batches:
            targets = batch.column(0)
            many, x = pc.list_value_length(targets).to_numpy(), pc.list_flatten(targets).to_numpy()
            near = np.minimum(np.searchsorted(taxa, x), len(taxa) - 1)
            place = np.where(taxa[near] == x, places[near], other)
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (many.astype("<i4"), place.astype("<i4"), batch.column(1).to_numpy().astype("<f8"))], names=["many", "place", "weight"])

    def share(row: tuple[bytes, bytes, bytes], a: np.ndarray) -> np.ndarray:
        many, place, weight = (np.frombuffer(x, t) for x, t in zip(row, ("<i4", "<i4", "<f8"), strict=True))
        who = np.repeat(np.arange(len(many)), many)
        total = np.bincount(who, a[place], len(many))[who]
        part = np.where(total > 0, a[place] / np.where(total > 0, total, 1), 1 / many[who])
        return np.bincount(place, weight[who] * part, n)

    packed = stored(assigned.select("targets", "weight").mapInArrow(pack, "many binary, place binary, weight binary").withColumn("part", F.spark_partition_id()))
    if assigned.count() <= most_rows:
        held = [(r["many"], r["place"], r["weight"]) for r in packed.collect()]
        return lambda a: sum((share(r, a) for r in held), np.zeros(n))

    def passed(a: np.ndarray) -> np.ndarray:
        shipped = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(n), None
            for batch in batches:
                *columns, parts = (c.to_pylist() for c in batch.columns)
                for row, part in zip(zip(*columns, strict=True), parts, strict=True):
                    total += share(row, shipped.value)
            if part is not None:
                for i in range(0, n, slice_):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part], pa.int32()), pa.array([total[i : i + slice_].tobytes()], pa.binary())], names=["at", "part", "total"])

        def add(group: pa.Table) -> pa.Table:  # in one order, so reruns agree
            total = sum(np.frombuffer(x, "<f8") for x in group.sort_by("part").column("total").to_pylist())
            return pa.table([group.column("at").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["at", "total"])

        out = packed.mapInArrow(run, "at long, part int, total binary").groupBy("at").applyInArrow(add, "at long, total binary")
        whole = np.concatenate([np.frombuffer(r["total"], "<f8") for r in sorted(out.collect(), key=lambda r: r["at"])])
        shipped.destroy()
        return whole

    return passed


def quant_report(rows: DataFrame, nodes: DataFrame, up: DataFrame, lengths: DataFrame, root: int, exact: bool = False) -> DataFrame:
    """name, taxID, taxRank, genomeSize, numReads, numUniqueReads, abundance of every covered taxon; exact adds reads, their count before it is cut to whole reads."""
    spark = rows.sparkSession
    known = assignments(rows).persist()
    counts = read_counts(known, nodes, up, root)
    share = spark.createDataFrame(list(abundances(known, nodes, up, lengths, root).items()) or [(0, 0.0)], "tax_id long, abundance double")
    out = counts.where("reads >= 1e-6").join(nodes, "tax_id").join(lengths, "tax_id", "left").join(share, "tax_id", "left")
    return out.select("name", F.col("tax_id").alias("taxID"), F.col("rank").alias("taxRank"), F.coalesce("length", F.lit(1_000_000)).alias("genomeSize"), F.floor(F.col("reads") + 1e-3).cast("int").alias("numReads"), F.floor(F.col("uniq") + 1e-3).cast("int").alias("numUniqueReads"), F.coalesce("abundance", F.lit(0.0)).alias("abundance"), *([F.col("reads")] if exact else []))


def clade_report(rows: DataFrame, nodes: DataFrame, up: DataFrame, root: int, with_lca: bool = True, zeros: bool = False, scores: bool = False, least_score: int | None = None, least_length: int | None = None) -> DataFrame:
    """tax_id, clade_reads, own_reads, percent: each read at its LCA, or shared by its rows (1 / numMatches each, or their number where there is no such column). Rows below least_score or least_length don't count.

    Taxon 0 is unclassified: a row of its own outside the tree, where there are such reads; beside other taxa of a read
    it counts only without LCA. zeros adds the tree's clades without reads. scores adds the best score of each clade: a
    read's is that of its first row by row_no if there is one, and it counts with LCA only; elsewhere the score is 0.
    """
    if least_score is not None:
        rows = rows.where(F.col("score") >= least_score)
    if least_length is not None:
        rows = rows.where(F.col("hitLength") >= least_length)
    keep = [*(["score"] if scores else []), *(["m"] if not with_lca and "numMatches" in rows.columns else [])]
    rows = rows.withColumn("m", F.col("numMatches")) if "m" in keep else rows
    order = ["row_no"] if scores and "row_no" in rows.columns else []
    known = rows.select(F.col("readID").alias("read"), F.col("taxID").alias("tax_id"), *keep, *order)
    known = known.join(nodes.select("tax_id", F.lit(True).alias("there")), "tax_id", "left")
    known = known.select("read", F.when(F.col("there") | (F.col("tax_id") == 0), F.col("tax_id")).otherwise(F.lit(root)).alias("tax_id"), *keep, *order)
    if with_lca:
        some = known.where("tax_id <> 0")
        none = known.where("tax_id = 0").select("read").distinct().join(some, "read", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("own_reads")).where("own_reads > 0")
        at = T.lca(some.select("read", "tax_id"), up, root).select("read", F.col("lca").alias("tax_id"))
        own = at.groupBy("tax_id").agg(F.count(F.lit(1)).cast("double").alias("own_reads"))
        own = own.unionByName(none.select(F.lit(0).cast("long").alias("tax_id"), "own_reads"))
    else:
        if "numMatches" not in rows.columns:
            known = known.join(known.groupBy("read").agg(F.count(F.lit(1)).alias("m")), "read")
        own = known.groupBy("tax_id").agg(F.sum(1 / F.col("m")).alias("own_reads"))
    first = known.groupBy("read").agg((F.min_by("score", "row_no") if order else F.max("score")).alias("score")) if scores and with_lca else None
    best = first.join(at, "read").groupBy("tax_id").agg(F.max("score").alias("score")) if first is not None else None
    return _clades(own, up, root, zeros, scores, best)


def clade_report_of_counts(counts: DataFrame, nodes: DataFrame, up: DataFrame, root: int, zeros: bool = False) -> DataFrame:
    """The clade report of a count table (tax_id, count): of repeated taxa the last row by row_no counts in the tree and all in the total. Taxa outside the tree are in the total only; taxon 0 is unclassified."""
    total = counts.agg(F.sum("count").cast("double").alias("total"))  # one row
    own = counts.groupBy("tax_id").agg(F.max_by("count", "row_no").cast("double").alias("own_reads"))
    own = own.join(nodes.select("tax_id").unionByName(nodes.sparkSession.range(1).select(F.col("id").alias("tax_id"))), "tax_id", "left_semi")
    return _clades(own, up, root, zeros, False, None, total)


def _clades(own: DataFrame, up: DataFrame, root: int, zeros: bool, scores: bool, best: DataFrame | None, total: DataFrame | None = None) -> DataFrame:
    """own_reads of taxa summed up the tree, with shares of the total and, if asked, the best score of each clade."""
    counts = own.withColumnRenamed("own_reads", "clade_reads")
    clades = T.roll_up(counts.where("tax_id <> 0"), up, "clade_reads").unionByName(counts.where("tax_id = 0"))
    if zeros:
        tree = up.where(F.col("anc") == root).select("tax_id")
        clades = tree.join(clades, "tax_id", "full").select("tax_id", F.coalesce("clade_reads", F.lit(0.0)).alias("clade_reads"))
    total = own.agg(F.sum("own_reads").alias("total")) if total is None else total  # one row
    out = clades.join(own, "tax_id", "left")
    if best is not None:
        out = out.join(best.join(up, "tax_id").groupBy(F.col("anc").alias("tax_id")).agg(F.max("score").alias("score")), "tax_id", "left")
    elif scores:
        out = out.withColumn("score", F.lit(0).cast("long"))
    out = out.crossJoin(F.broadcast(total))
    extra = [F.coalesce("score", F.lit(0)).alias("score")] if scores else []
    return out.select("tax_id", "clade_reads", F.coalesce("own_reads", F.lit(0.0)).alias("own_reads"), F.coalesce(100 * F.col("clade_reads") / F.col("total"), F.lit(0.0)).alias("percent"), *extra)
