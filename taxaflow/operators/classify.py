"""From hits of reads to one classification: strand choice, joined hits, best sequences, reduction to k targets.

hits: read, mate (1 or 2), strand (1 or -1), hit, seq, offset, length, occurrences, a row for each sequence of a hit, as
search() gives them. All steps partition by read, so a read's hits are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.sequence import hit_score
from taxaflow.operators import taxonomy as T
from taxaflow.storage import stored


def choose_strand(hits: DataFrame, least: int = 23, adjust: int = 15) -> DataFrame:
    """hits with `pool` (the fragment's strand: a second mate reads the other one) and `mixed`; only hits of the pool that scores more than 1 % higher stay, of both if neither does."""
    w = W.partitionBy("read")
    first = F.row_number().over(W.partitionBy("read", "mate", "strand", "hit").orderBy("seq")) == 1  # a hit counts once, whatever its sequences
    score = F.when(first, hit_score(F.col("length"), least, adjust)).otherwise(F.lit(0))
    rows = hits.withColumn("pool", F.when(F.col("mate") == 2, -F.col("strand")).otherwise(F.col("strand"))).withColumn("own", score)
    rows = rows.withColumn("plus", F.sum(F.when(F.col("pool") == 1, F.col("own")).otherwise(0)).over(w)).withColumn("minus", F.sum(F.when(F.col("pool") == -1, F.col("own")).otherwise(0)).over(w))
    one = F.when(F.col("plus") > F.col("minus") + F.expr("minus div 100"), F.lit(1)).when(F.col("minus") > F.col("plus") + F.expr("plus div 100"), F.lit(-1)).otherwise(F.lit(0))
    return rows.withColumn("one", one).where("one = 0 or one = pool").withColumn("mixed", F.col("one") == 0).drop("own", "plus", "minus", "one")


def join_adjacent(hits: DataFrame, least: int = 23) -> DataFrame:
    """(read, pool, seq, part, length): hits of a sequence; neighbouring ones that each occur once, one base apart, on one sequence are one longer hit."""
    w = W.partitionBy("read", "pool").orderBy("mate", "strand", "hit", "seq")
    kept = hits.where(F.col("length") >= least)

    def before(name: str) -> F.Column:
        return F.lag(name).over(w)

    goes_on = ~F.col("mixed") & (F.col("occurrences") == 1) & (before("occurrences") == 1) & (before("mate") == F.col("mate")) & (before("strand") == F.col("strand")) & (before("seq") == F.col("seq")) & (before("offset") + before("length") + 1 == F.col("offset"))
    rows = kept.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("read", "pool", "seq", "part").agg(F.sum("length").alias("length"))


def sequence_scores(parts: DataFrame, least: int = 23, adjust: int = 15) -> DataFrame:
    """(read, pool, seq, score, hit_length)."""
    return parts.groupBy("read", "pool", "seq").agg(F.sum(hit_score(F.col("length"), least, adjust)).alias("score"), F.sum("length").alias("hit_length"))


def best_sequences(scores: DataFrame, near_length: int = 2000, near_share: float = 0.995) -> DataFrame:
    """(read, seq, score, second, hit_length, n) of the best sequences, minus strand first; a second score within near_share of the best joins it on long hits. n: sequences of the read."""
    w = W.partitionBy("read").orderBy(F.desc("score"), "pool", "seq")
    ranked = scores.withColumn("r", F.row_number().over(w))
    whole = W.partitionBy("read")
    for name, at in (("best", 1), ("second", 2)):
        ranked = ranked.withColumn(name, F.max(F.when(F.col("r") == at, F.col("score"))).over(whole))
    ranked = ranked.withColumn("length1", F.max(F.when(F.col("r") == 1, F.col("hit_length"))).over(whole)).withColumn("length2", F.max(F.when(F.col("r") == 2, F.col("hit_length"))).over(whole))
    # the next lower score, for what joins the best
    close = (F.col("length2") >= near_length) & (F.col("best") > F.col("second")) & (F.col("second") >= F.floor(F.col("best") * near_share))
    kept = ranked.where((F.col("score") == F.col("best")) | (F.coalesce(close, F.lit(False)) & (F.col("score") == F.col("second"))))
    one = kept.groupBy("read", "seq").agg(F.max("best").alias("score"), F.coalesce(F.max("second"), F.lit(0)).alias("second"), F.max("length1").alias("hit_length"))
    return one.withColumn("n", F.count(F.lit(1)).over(whole))


def classify(reads: DataFrame, hits: DataFrame, sequences: DataFrame, nodes: DataFrame, up: DataFrame, root: int, k: int = 1, least: int = 23, adjust: int = 15, expanded: bool = False) -> DataFrame:
    """readID, seqID, taxID, score, 2ndBestScore, hitLength, queryLength, numMatches of every read.

    reads: read, id, query_length. sequences: seq, name, tax_id (one outside the tree or null is shown as the root). A read with more
    than k best sequences gets the taxa they reduce to, with the rank in seqID; one without hits is unclassified. Columns
    barcode and UMI of reads are kept. expanded adds expandedTaxIDs: by ids, the taxa that a reduced one stands for.
    """
    best = stored(best_sequences(sequence_scores(join_adjacent(choose_strand(hits, least, adjust), least), least, adjust)))  # read several times below, as are the next two: else the plan holds it each time
    top = F.lit(root).cast("long")
    known = nodes.select("tax_id", F.col("tax_id").alias("known"))
    named = stored(best.join(sequences.select("seq", "name", "tax_id"), "seq").join(known, "tax_id", "left").withColumn("tax_id", F.col("known")))
    few = named.where(F.col("n") <= k).select("read", F.col("name").alias("seqID"), F.coalesce("tax_id", top).alias("tax_id"))
    many = named.where(F.col("n") > k).select("read", "tax_id").distinct()
    ranks = nodes.select("tax_id", F.col("rank").alias("seqID"))
    reduced = T.reduce_to_k(many, nodes, up, root, k).join(ranks, "tax_id", "left").select("read", F.coalesce("seqID", F.lit("no rank")).alias("seqID"), F.coalesce("tax_id", top).alias("tax_id"))
    rows = stored(few.unionByName(reduced))
    extra = [c for c in ("barcode", "UMI") if c in reads.columns]
    if expanded:
        children = T.expanded_taxa(many, nodes, up, root, k).select("read", F.coalesce("tax_id", top).alias("tax_id"), F.coalesce("child", top).alias("child"))
        children = children.groupBy("read", "tax_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("child")), lambda x: x.cast("string")), ",").alias("expandedTaxIDs"))
        rows = rows.join(children, ["read", "tax_id"], "left")
        extra.append("expandedTaxIDs")
    facts = best.groupBy("read").agg(F.max("score").alias("score"), F.max("second").alias("second"), F.max("hit_length").alias("hit_length"))
    counts = rows.groupBy("read").agg(F.count(F.lit(1)).alias("m"))
    out = reads.join(rows.join(facts, "read").join(counts, "read"), "read", "left")
    zero = F.lit(0)
    return out.select(F.col("id").alias("readID"), F.coalesce("seqID", F.lit("unclassified")).alias("seqID"), F.coalesce("tax_id", zero).cast("long").alias("taxID"), F.coalesce("score", zero).cast("long").alias("score"), F.coalesce("second", zero).cast("long").alias("2ndBestScore"), F.coalesce("hit_length", zero).cast("int").alias("hitLength"), F.col("query_length").cast("int").alias("queryLength"), F.coalesce("m", F.lit(1)).cast("int").alias("numMatches"), *[F.coalesce(c, F.lit("")).alias(c) for c in extra])
