"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is cut into shards by a hash of doc_id (a hot source gets more shards), every shard into blocks of equal
token counts. Seats (blocks) go to sources, then to each source's shards, by highest quotient votes / (2 * seats + 1).
A shard with n blocks and s seats takes every block floor(s / n) times and s mod n blocks once more, chosen by a seeded
permutation of the block numbers. A document's take is the overlap of its words with the chosen blocks.

The quotas are DataFrame code: two aggregations, windows over sources and shards, and one window over each shard's
documents (bounded by `shard_docs`). Nothing is collected. apply() cuts the chosen words out of the texts in one pass.

Null text has size 0; a null source is a source of its own, ordered last; an empty table gives an empty result; repeated
rows are separate documents; a null doc_id is placed like any other value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.llm.common import ensure_checkpoint_dir, slices, word_bounds

WORD = r"[^\x20\x09-\x0D]+"
_MULTIPLIERS = (1000003, 1000033)  # primes; the second serves block counts that the first divides


def sainte_lague(df: DataFrame, group: list[str], key: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """df plus `got`: `seats` (one number for each group) shared among its rows by highest quotient, ties to the smaller key, none above cap.

    Rounding votes at a divisor known to be large enough hands out all but a few seats at once; the rest are ranked by quotient.
    """
    g = W.partitionBy(*group)
    total, rows = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    base = df.withColumns({"_v": total, "_m": rows})
    room = F.col(seats) - F.col("_m") / 2
    base = base.withColumn("_s", F.when((room > 0) & (F.col("_v") > 0), F.least(F.col(cap), F.floor(F.col(votes) * room / F.col("_v") + 0.5))).otherwise(F.lit(0)).cast("long"))
    base = base.withColumn("_left", F.col(seats) - F.sum("_s").over(g))
    # no row can gain more than its share of the rows plus two
    more = F.least(F.col(cap) - F.col("_s"), F.ceil(F.col(votes) * F.col("_m") / F.col("_v")).cast("long") + 2)
    tries = base.withColumn("_i", F.explode(F.when((more > 0) & (F.col(votes) > 0), F.sequence(F.lit(0).cast("long"), more - 1)).otherwise(F.array().cast("array<bigint>"))))
    quotient = F.col(votes) / (2 * (F.col("_s") + F.col("_i")) + 1)
    ranked = tries.withColumn("_r", F.row_number().over(g.orderBy(quotient.desc(), *key)))
    won = ranked.where("_r <= _left").groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group + key)]).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group + key)]
    return base.join(won, same, "left").withColumn("got", F.col("_s") + F.coalesce("_won", F.lit(0))).select(*df.columns, "got")


def water_fill(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """`target` of each source: share of all sizes by weight, none above most times its size, the excess reshared by weight."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy((F.col("most") / F.col("weight")).asc(), "rank").rowsBetween(W.unboundedPreceding, -1)
    base = base.withColumns({"_all": F.sum("source_size").over(every) * F.lit(float(share)), "_w": F.sum("weight").over(every), "_c": F.coalesce(F.sum("most").over(up), F.lit(0.0)), "_u": F.coalesce(F.sum("weight").over(up), F.lit(0.0))})
    level = (F.col("_all") - F.col("_c")) / (F.col("_w") - F.col("_u"))
    base = base.withColumn("_level", F.when(level * F.col("weight") < F.col("most"), level))
    # the lowest source that isn't filled sets the level of it and all above
    base = base.withColumn("_level", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("most") / F.col("weight"))).over(every))
    return base.withColumn("target", F.when(F.col("_level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("_level") * F.col("weight")))).select("source", "rank", "source_size", "n_docs", "target")


def _spread(x: Column, seed: int) -> Column:
    """An even spread of longs over 31 bits, in arithmetic that any SQL engine repeats."""
    return F.pmod(F.pmod(x, F.lit(2147483647)) * F.lit(2654435761) + F.lit(seed), F.lit(2147483647))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 32, shard_docs: int = 4096, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with where its words lie in its shard (begin, end) and what the shard is granted: doc_id, the columns in keep, size, source_size, target, begin, end, words, blocks, seats, shift, times."""
    ensure_checkpoint_dir(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.xxhash64("text").alias("_tie")  # rows of one doc_id keep one order, and rows without doc_id spread
    sized = docs.select("doc_id", "source", *keep, size.alias("size"), tie)
    sized = sized if keep else sized.checkpoint()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = water_fill(totals, weights, share, most).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    sources = sources.withColumnRenamed("source", "_source")
    placed = sized.join(sources.select("_source", "rank", "n_shards"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", F.pmod(_spread(F.coalesce("doc_id", "_tie"), seed), F.col("n_shards")))
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words")).where("words > 0").withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    per_source = shards.groupBy("rank").agg(F.sum("blocks").alias("source_blocks")).join(sources, "rank")
    per_source = per_source.withColumn("votes", F.col("target") * F.col("source_blocks") / F.col("source_size")).withColumns({"cap": F.floor(F.col("source_blocks") * F.lit(most)).cast("long"), "one": F.lit(0)})
    per_source = per_source.withColumn("seats", F.round(F.sum("votes").over(W.partitionBy("one"))).cast("long"))
    won = sainte_lague(per_source, ["one"], ["rank"], "votes", "seats", "cap").select("rank", F.col("got").alias("source_seats"))
    shards = shards.join(won, "rank").withColumns({"shard_votes": F.col("blocks").cast("double"), "shard_cap": F.floor(F.col("blocks") * F.lit(most)).cast("long")})
    shards = sainte_lague(shards, ["rank"], ["shard"], "shard_votes", "source_seats", "shard_cap").select("rank", "shard", "words", "blocks", F.col("got").alias("seats"))
    w = W.partitionBy("rank", "shard").orderBy("doc_id", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("begin", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("end", F.col("begin") + F.col("size"))
    laid = laid.join(shards, ["rank", "shard"], "left").join(sources.select("rank", "source_size", "target"), "rank")
    n = F.col("blocks")
    shift = _spread(F.col("shard") * 40503 + F.col("rank"), seed + 1)
    times = F.when(F.pmod(n, F.lit(_MULTIPLIERS[0])) == 0, F.lit(_MULTIPLIERS[1])).otherwise(F.lit(_MULTIPLIERS[0])).cast("long")
    return laid.select("doc_id", *keep, "size", "source_size", "target", "begin", "end", "words", "blocks", "seats", shift.alias("shift"), times.alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document. Options as in plan()."""
    n, total = F.col("blocks"), F.col("words")
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.col("begin") * n / total).cast("long") - 1)
    high = F.least(n - 1, F.floor(F.col("end") * n / total).cast("long") + 1)

    def overlap(acc: Column, j: Column) -> Column:
        at, to = F.floor(j * total / n).cast("long"), F.floor((j + 1) * total / n).cast("long")
        inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), to) - F.greatest(F.col("begin"), at))
        return acc + F.when(F.pmod(j * F.col("times") + F.col("shift"), n) < F.pmod(F.col("seats"), n), inside).otherwise(F.lit(0).cast("long"))

    extra = F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), overlap)
    taken = F.when(F.col("size") > 0, F.col("size") * F.floor(F.col("seats") / n).cast("long") + extra).otherwise(F.lit(0).cast("long"))
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of docs (doc_id, text, source and any others): a row for each time a document is taken whole, and one with the words of its chosen blocks. Documents without words leave."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    names = [f"kept_{i}" for i in range(len(keep))]
    renamed = docs.select("doc_id", "source", *(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.col("source").alias("_src"), *([F.col("text")] if "text" not in names else []))
    planned = plan(renamed, keep=("_src", *names), **options)
    at = names[keep.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 8 << 20):
            get = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names) if f in (at, "size", "begin", "end", "words", "blocks", "seats", "shift", "times")}
            row, texts = [], []
            for i in range(batch.num_rows):
                if not get["size"][i]:
                    continue
                n, total = get["blocks"][i], get["words"][i]
                whole, extra = divmod(get["seats"][i], n)
                row += [i] * whole
                texts += [get[at][i]] * whole
                if extra:
                    begin, end = get["begin"][i], get["end"][i]
                    j = np.arange(max(0, begin * n // total - 1), min(n, end * n // total + 2))
                    j = j[(j * get["times"][i] + get["shift"][i]) % n < extra]
                    a, b = np.maximum(j * total // n, begin) - begin, np.minimum((j + 1) * total // n, end) - begin
                    a, b = a[a < b], b[a < b]
                    if len(a):
                        raw = get[at][i].encode()
                        s, e, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                        first = np.append(True, a[1:] != b[:-1])
                        k = np.flatnonzero(first)
                        a, b = a[k], b[np.append(k[1:], len(b)) - 1]
                        row.append(i)
                        texts.append("\n".join(raw[x:y].decode() for x, y in zip(s[a].tolist(), e[b - 1].tolist(), strict=True)))
            made = batch.take(pa.array(row, pa.int64()))
            cols = {f: made.column(i) for i, f in enumerate(made.schema.names)}
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] for c in ("doc_id", "_src", *names)], names=["doc_id", "_src", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planned.select("doc_id", "_src", *names).schema)
    out = planned.mapInArrow(run, kinds)
    back = {"doc_id": F.col("doc_id"), "source": F.col("_src").alias("source")} | {c: F.col(k).alias(c) for c, k in zip(keep, names, strict=True)}
    if "n_chars" in keep:
        back["n_chars"] = F.length(at).cast("long").alias("n_chars")
    return out.select(*(back[c] for c in docs.columns))
