"""Mixing sources to target weights.

1. words per document, words per source (one pass, partial aggregation);
2. targets: sources share ``share`` times all words by weight, none above
   ``cap`` times its own words.  Resharing an excess by weight keeps the
   targets of the uncapped sources in proportion to their weights, so the
   targets are ``min(cap_i, level * weight_i)`` for one common ``level``; it
   is read off the sources sorted by ``cap_i / weight_i``;
3. repetition rate ``target / words`` per source; each document is emitted
   ``floor(rate)`` times plus one copy when its seeded hash falls below the
   fraction.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and its documents are
taken 0 words; rows of a null or repeated key are numbered within it, in the
order of their content, and the number is hashed too, so that each draws for
itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.ordered import ranked

from .common import fits, materialize, unit_hash, word_count

#: The source table is broadcast up to this many sources, else joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target, rate) from (source, size) rows.

    The windows below run over one row per source, never over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pos + 1))
    full = Window.partitionBy()
    by_level = Window.orderBy((F.col("limit_") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("limit_", F.lit(cap) * F.col("source_size"))
    per = per.withColumn("total_", F.lit(share) * F.sum("source_size").over(full))
    per = per.withColumn("left_", F.col("total_") - F.coalesce(F.sum("limit_").over(before), F.lit(0.0)))
    per = per.withColumn("weights_", F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level_", F.col("left_") / F.col("weights_"))
    # sources before the first that stays under its limit do not qualify, later levels are no higher
    per = per.withColumn("level", F.max(F.when(F.col("level_") * F.col("weight") <= F.col("limit_"), F.col("level_")))
                         .over(full))
    target = F.least(F.col("limit_"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit_")))
    return per.select("source", "source_size", "weight", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _with_chance(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` and a draw in [0, 1) each.  Only rows of null or repeated keys
    are numbered, by a distributed scan that deals out a hot key."""
    again = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
                        .select(F.col("doc_id").alias("doc_id_")), "mix-again")
    if again.isEmpty():
        return rows.withColumn("chance", unit_hash(F.lit(str(seed)), "doc_id"))
    same = rows["doc_id"].eqNullSafe(again["doc_id_"])
    single = rows.join(again, same, "left_anti").withColumn("chance", unit_hash(F.lit(str(seed)), "doc_id"))
    shared = ranked(rows.join(again, same, "left_semi"), ["source"], ["doc_id"], "number_")
    return single.unionByName(shared.withColumn("chance", unit_hash(F.lit(str(seed)), "doc_id", "number_")).drop("number_"))


def _with_copies(rows: DataFrame, sizes: DataFrame, seed: int, **kw) -> DataFrame:
    """``rows`` (doc_id, source, ...) with the target, rate and copies of each."""
    targets = materialize(source_targets(sizes, **kw), "mix-targets").withColumnRenamed("source", "source_")
    small = fits(targets, BROADCAST_SOURCES)
    out = rows.join(F.broadcast(targets) if small else targets, rows["source"].eqNullSafe(targets["source_"]))
    out = _with_chance(out, seed)
    chance = F.col("chance")
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long"))
                          .cast("long"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             seed: int = 17, **kw) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies and taken (``size * copies``).

    The texts are read once: the sizes are written before the sources are
    summed."""
    sizes = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                                    word_count(F.col(text)).alias("size")), "mix-sizes")
    return (_with_copies(sizes, sizes, seed, **kw)
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = 17, **kw) -> DataFrame:
    """The mixture: the columns of ``docs``, each row repeated as planned."""
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.struct("*").alias("row"))
    return (_with_copies(rows, sizes, seed, **kw).where(F.col("copies") > 0)
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("row.*"))
