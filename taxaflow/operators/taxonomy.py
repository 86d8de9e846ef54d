"""Taxonomy operators. A tree is (tax_id, parent_id, rank); every traversal is a join with its closure.

The closure (tax_id, anc, depth: steps up) is built by path doubling: rounds grow with the logarithm of the tree's height.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.storage import stored

# Ranks of each level, 0 to 8; every other rank is level 9.
LEVELS = (
    ("strain", "subspecies"),
    ("species",),
    ("genus", "subgenus"),
    ("family", "superfamily", "subfamily"),
    ("order", "suborder", "infraorder", "parvorder", "superorder"),
    ("class", "infraclass", "superclass", "subclass"),
    ("phylum", "subphylum", "superphylum"),
    ("kingdom", "subkingdom"),
    ("superkingdom", "acellular root", "domain"),
)
# Ranks that reports keep.
CANONICAL = ("strain", "species", "genus", "family", "order", "class", "phylum", "kingdom", "superkingdom", "domain", "acellular root")


def rank_level(rank: Column) -> Column:
    return reduce(lambda e, kv: e.when(rank.isin(*kv[1]), F.lit(kv[0])), enumerate(LEVELS[1:], 1), F.when(rank.isin(*LEVELS[0]), F.lit(0))).otherwise(F.lit(9))


def closure(nodes: DataFrame, most: int = 12) -> DataFrame:
    """(tax_id, anc, depth) with every node's own row. Each round doubles the steps covered and is stored, so no round is computed twice; it ends when no lineage is longer. Steps beyond 2 ** most raise an error."""
    nodes = nodes.select("tax_id", "parent_id")
    known = nodes.select("tax_id", F.col("tax_id").alias("anc"), F.lit(0).alias("depth"))
    jump, size = stored(nodes.where("tax_id <> parent_id").select("tax_id", F.col("parent_id").alias("anc"))), 1
    for _ in range(most):
        if jump.isEmpty():
            break
        far = known.select("tax_id", F.col("anc").alias("mid"), "depth").join(jump.select(F.col("tax_id").alias("mid"), "anc"), "mid").select("tax_id", "anc", (F.col("depth") + size).alias("depth"))
        known = stored(known.unionByName(far))
        jump = stored(jump.select("tax_id", F.col("anc").alias("mid")).join(jump.select(F.col("tax_id").alias("mid"), "anc"), "mid").select("tax_id", "anc"))
        size *= 2
    else:
        if not jump.isEmpty():
            raise RuntimeError(f"a lineage of {size} steps or more, or a cycle")
    return known


def prune(nodes: DataFrame, up: DataFrame, present: DataFrame) -> DataFrame:
    """The nodes that are a present taxon or an ancestor of one."""
    return nodes.join(up.join(present.select("tax_id").distinct(), "tax_id", "left_semi").select(F.col("anc").alias("tax_id")).distinct(), "tax_id", "left_semi")


def subtree(nodes: DataFrame, up: DataFrame, top: int) -> DataFrame:
    return nodes.join(up.where(F.col("anc") == top).select("tax_id"), "tax_id", "left_semi")


def root_of(nodes: DataFrame) -> int:
    return nodes.where("tax_id = parent_id").agg(F.min("tax_id")).first()[0]


def lca(targets: DataFrame, up: DataFrame, root: int, key: str = "read") -> DataFrame:
    """(key, lca, n) over rows (key, tax_id): the deepest node above all targets; targets at the root count only if all are."""
    below = targets.where(F.col("tax_id") != root).dropDuplicates([key, "tax_id"])
    many = below.groupBy(key).agg(F.count(F.lit(1)).alias("distinct_n"))
    shared = below.join(up.where(F.col("anc") != root), "tax_id").groupBy(key, "anc").agg(F.count(F.lit(1)).alias("c"), F.min("depth").alias("near"))
    best = shared.join(many, key).where("c = distinct_n").join(up.groupBy("tax_id").agg(F.max("depth").alias("below_root")).withColumnRenamed("tax_id", "anc"), "anc")
    best = best.groupBy(key).agg(F.max_by("anc", "below_root").alias("found"))
    return targets.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(best, key, "left").select(key, F.coalesce("found", F.lit(root)).alias("lca"), "n")


def level_ancestors(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(tax_id, level 1-8, anc): the ancestor that stands for a level; levels that a lineage skips take the next higher one. The root stands for none."""
    ranked = nodes.where("tax_id <> parent_id").select(F.col("tax_id").alias("anc"), rank_level(F.col("rank")).alias("own")).where("own between 1 and 8")
    return up.join(ranked, "anc").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("own")))).groupBy("tax_id", "level").agg(F.min_by("anc", F.struct("own", "depth")).alias("anc"))


def reduce_to_k(targets: DataFrame, nodes: DataFrame, up: DataFrame, root: int, k: int, key: str = "read") -> DataFrame:
    """(key, tax_id): at most k targets stay as they are, whatever they are. Of more, one outside the tree gives one row with a null taxon; else they are promoted to the lowest level that leaves at most k taxa (level 0: the targets themselves); k = 1 is the LCA; none fits: the root."""
    here = nodes.select("tax_id", F.lit(True).alias("there"))
    known = targets.select(key, "tax_id").join(here, "tax_id", "left")
    many = known.groupBy(key).agg((F.count(F.lit(1)) > k).alias("many"), (F.count("there") < F.count(F.lit(1))).alias("outside"))
    known = known.join(many, key)
    kept = known.where("not many").select(key, "tax_id").distinct()
    lost = many.where("many and outside").select(key, F.lit(None).cast("long").alias("tax_id"))
    most = known.where("many and not outside").select(key, "tax_id").distinct()
    if k == 1:
        found = lca(most, up, root, key).select(key, F.col("lca").alias("tax_id"))
    else:
        lifted = most.join(level_ancestors(nodes, up), "tax_id").select(key, "level", "anc").unionByName(most.select(key, F.lit(0).alias("level"), F.col("tax_id").alias("anc")))
        fits = lifted.groupBy(key, "level").agg(F.collect_set("anc").alias("set")).where(F.size("set") <= k).groupBy(key).agg(F.min_by("set", "level").alias("set"))
        found = most.select(key).distinct().join(fits, key, "left").select(key, F.explode(F.coalesce("set", F.array(F.lit(root).cast("long")))).alias("tax_id"))
    return kept.unionByName(lost).unionByName(found)


def expanded_taxa(targets: DataFrame, nodes: DataFrame, up: DataFrame, root: int, k: int, key: str = "read") -> DataFrame:
    """(key, tax_id, child): what each taxon of reduce_to_k() stands for, of keys with more than k targets.

    k = 1: the children of the LCA that the targets are in or below. Above, where targets were promoted: the taxa of the
    level below whose next ancestor of the result's level or a higher one is that taxon; an unranked one between them counts
    as higher. Targets with one outside the tree all stand under the null taxon.
    """
    known = targets.select(key, "tax_id").join(nodes.select("tax_id", F.lit(True).alias("there")), "tax_id", "left")
    many = known.groupBy(key).agg((F.count(F.lit(1)) > k).alias("many"), (F.count("there") < F.count(F.lit(1))).alias("outside")).where("many")
    known = known.join(many, key)
    lost = known.where("outside").select(key, F.lit(None).cast("long").alias("tax_id"), F.col("tax_id").alias("child"))
    most = known.where("not outside").select(key, "tax_id").distinct()
    parents = nodes.where("tax_id <> parent_id").select(F.col("tax_id").alias("child"), F.col("parent_id").alias("found"))
    if k == 1:
        at = lca(most, up, root, key).select(key, F.col("lca").alias("found"))
        steps = most.join(up, "tax_id").select(key, F.col("anc").alias("child")).distinct().join(parents, "child")
        return lost.unionByName(steps.join(at, [key, "found"]).select(key, F.col("found").alias("tax_id"), "child"))
    lifted = most.join(level_ancestors(nodes, up), "tax_id").select(key, "level", "anc").unionByName(most.select(key, F.lit(0).alias("level"), F.col("tax_id").alias("anc"))).distinct()
    fits = lifted.groupBy(key, "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= k).groupBy(key).agg(F.min("level").alias("at")).where("at > 0")
    ranks = nodes.select(F.col("tax_id").alias("found"), rank_level(F.col("rank")).alias("own"))
    above = up.where("depth > 0").select(F.col("tax_id").alias("child"), F.col("anc").alias("found"), "depth").join(ranks, "found")
    below = lifted.join(fits, key).where("level = at - 1").select(key, "at", F.col("anc").alias("child")).join(above, "child").where("own >= at")
    nearest = below.groupBy(key, "child", "at").agg(F.min_by(F.struct("found", "own"), "depth").alias("a")).where("a.own = at")
    kept = lifted.join(fits, key).where("level = at").select(key, F.col("anc").alias("found"))
    return lost.unionByName(nearest.select(key, F.col("a.found").alias("found"), "child").join(kept, [key, "found"], "left_semi").select(key, F.col("found").alias("tax_id"), "child"))


def general_tree(nodes: DataFrame, root: int) -> DataFrame:
    """One tree: every other node that is its own parent becomes a child of the root."""
    return nodes.withColumn("parent_id", F.when(F.col("tax_id") == F.col("parent_id"), F.lit(root).cast("long")).otherwise(F.col("parent_id")))


def named_taxa(ids: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """ids (tax_id) with known_id, name and rank; a taxon outside the tree shows the root's id, Unknown and no rank."""
    here = nodes.select("tax_id", F.col("tax_id").alias("known_id"), "name", "rank")
    return ids.join(here, "tax_id", "left").withColumns({"known_id": F.coalesce("known_id", F.lit(root).cast("long")), "name": F.coalesce("name", F.lit("Unknown")), "rank": F.coalesce("rank", F.lit("no rank"))})


def promote(rows: DataFrame, nodes: DataFrame, up: DataFrame, rank: str, key: str = "read") -> DataFrame:
    """rows (key, tax_id) with each taxon replaced by its nearest ancestor of a rank, where there is one; one row of each taxon and key."""
    at = up.join(nodes.where(F.col("rank") == rank).select(F.col("tax_id").alias("anc")), "anc").groupBy("tax_id").agg(F.min_by("anc", "depth").alias("up_id"))
    return rows.join(at, "tax_id", "left").select(key, F.coalesce("up_id", "tax_id").alias("tax_id")).distinct()


def roll_up(counts: DataFrame, up: DataFrame, *values: str) -> DataFrame:
    """Sums of values over each subtree: (tax_id, values)."""
    return counts.join(up, "tax_id").groupBy("anc").agg(*[F.sum(v).alias(v) for v in values]).withColumnRenamed("anc", "tax_id")


def lineage(up: DataFrame, nodes: DataFrame, root: int, value: str = "name") -> DataFrame:
    """(tax_id, lineage): values from below the root down, joined by |."""
    rows = up.where(F.col("anc") != root).join(nodes.select(F.col("tax_id").alias("anc"), value), "anc")
    return rows.groupBy("tax_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", value)), asc=False), lambda x: x[value].cast("string")), "|").alias("lineage"))


def taxon_lengths(seqs: DataFrame) -> DataFrame:
    """(tax_id, length) from (name, tax_id, length): neighbours in the order of all names are one genome if they share a taxon and their accession numbers follow each other; the longest counts.

    The order is made in two levels: ranges of names, then few numbers from range to range.
    """
    from taxaflow.functions.sequence import accession_number

    rows = seqs.select("name", "tax_id", "length", accession_number(F.col("name")).alias("number"))
    rows = stored(rows.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    me = F.struct("name", "tax_id", "number")
    w = W.partitionBy("part").orderBy("name")
    ends = rows.groupBy("part").agg(F.max(me).alias("end")).withColumn("carried", F.lag("end").over(W.orderBy("part")))  # a row a range
    rows = rows.join(F.broadcast(ends.select("part", "carried")), "part").withColumn("before", F.coalesce(F.lag(me).over(w), "carried"))
    follows = (F.col("before.tax_id") == F.col("tax_id")) & (F.col("before.number") + 1 == F.col("number"))
    rows = rows.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    starts = rows.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    runs = rows.join(F.broadcast(starts), "part").groupBy("tax_id", (F.col("base") + F.col("run")).alias("run")).agg(F.sum("length").alias("length"))
    return runs.groupBy("tax_id").agg(F.max("length").alias("length"))


def infer_lengths(lengths: DataFrame, up: DataFrame, given: bool = False) -> DataFrame:
    """Lengths of all taxa: the integer mean of a taxon's own length and those of the leaves below it. given: lengths of a size table stay as they are, and only other taxa are inferred."""
    own = lengths.where("length <> 0").select("tax_id", "length")
    leaves = own.join(up.where("depth > 0").select(F.col("anc").alias("tax_id")).distinct(), "tax_id", "left_anti")
    below = leaves.join(up.where("depth > 0"), "tax_id").select(F.col("anc").alias("tax_id"), "length")
    out = own.unionByName(below).groupBy("tax_id").agg(F.expr("sum(length) div count(1)").alias("length"))
    if given:
        out = out.join(own.select("tax_id", F.col("length").alias("own")), "tax_id", "left").select("tax_id", F.coalesce("own", "length").alias("length"))
    return out
