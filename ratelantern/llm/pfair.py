"""Mixing sources to target weights by Pfair scheduling.

A source with weight ``w`` out of ``q`` (the sum of all weights) owns the fraction ``w / q`` of
the slots of a training stream. Its k-th block (from 1) is released at slot ``floor((k-1) q / w)``
and due before slot ``ceil(k q / w)``; in each slot the released block with the earliest deadline
runs. At every slot each source is then less than one block away from its exact share.

All lags are zero after ``q`` slots, so the schedule repeats with period ``q``: the fold over
one period is the only sequential step, its size is given by the weights alone, and where a
block of any later period goes is arithmetic.

Blocks are hash buckets of a source, about ``block_docs`` documents each, so that placing a
document needs no numbering and no shuffle of texts (a bucket without documents leaves its slot empty).

* Nothing is dropped: a source that has run out leaves its slots empty, and the others go on.
* A null source is a source of its own. Ids that are null hash as empty text.
* Repeated rows share a block. An empty table gives an empty result.
* Columns of the input other than ``doc_id`` and ``source`` are kept by ``mixed`` unless their
  names are those of the columns added, which replace them.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_PERIOD = 100_000
ADDED = ("weight", "block", "slot", "release", "deadline")


def source_blocks(docs: DataFrame, weights: Mapping[str, int], default_weight: int, block_docs: int) -> DataFrame:
    """One row per source: weight and number of blocks."""
    named = F.lit(default_weight)
    for source, weight in weights.items():
        named = F.when(F.col("source") == source, F.lit(int(weight))).otherwise(named)
    return (
        docs.groupBy("source")
        .agg(F.count("*").alias("docs"))
        .select("source", named.cast("long").alias("weight"), F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"))
    )


def one_period(sources: DataFrame) -> DataFrame:
    """Slots of one period: source, weight, blocks, k (block within the period, from 0), slot.

    The sources (not their rows) meet in one row; a period above ``MAX_PERIOD`` is refused.
    """
    listed = sources.agg(F.sort_array(F.collect_list(F.struct("source", "weight", "blocks"))).alias("s"))
    listed = listed.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"]).alias("q"))
    listed = listed.where(
        F.when(F.col("q") > MAX_PERIOD, F.raise_error(F.lit("the weights add up to more than the longest period"))).otherwise(
            F.col("q") > 0
        )
    )

    def pick(state, slot):
        def candidate(x, j):
            k = F.get(state["next"], j)
            released = (k < x["weight"]) & (F.floor(k * F.col("q") / x["weight"]) <= slot)
            deadline = F.ceil((k + 1) * F.col("q") / x["weight"])
            return F.when(released, F.struct(deadline.alias("d"), j.alias("j")))

        chosen = F.array_min(F.transform("s", candidate))["j"]
        return F.struct(
            F.transform(state["next"], lambda k, j: F.when(j == chosen, k + 1).otherwise(k)).alias("next"),
            F.concat(state["out"], F.array(chosen)).alias("out"),
        )

    start = F.struct(
        F.transform("s", lambda x: F.lit(0).cast("long")).alias("next"),
        F.array().cast("array<int>").alias("out"),
    )
    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), start, pick, lambda state: state["out"])
    return (
        listed.select("s", "q", F.posexplode(order).alias("slot", "j"))
        .select("q", F.col("slot").cast("long"), F.get("s", F.col("j")).alias("x"))
        .select("q", "slot", "x.*")
        .withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1)
    )


def mixed(docs: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_docs: int = 64) -> DataFrame:
    """The documents with the slot in which their block is scheduled.

    Sources not named in ``weights`` have ``default_weight``; weights are positive integers.
    """
    if default_weight < 1 or min(weights.values(), default=1) < 1 or block_docs < 1:
        raise ValueError("weights and block size must be at least 1")
    kept = docs.drop(*ADDED).columns
    # All columns of the input travel in one, so that none of their names meets a helper's.
    docs = docs.select("doc_id", "source", F.struct(*kept).alias("row"))
    period = one_period(source_blocks(docs, weights, default_weight, block_docs)).select(
        F.col("source").alias("_source"), F.col("k").alias("_k"), F.col("slot").alias("_slot"), "q", "weight", "blocks"
    )
    per_source = period.where("_k = 0").select("_source", "q", "weight", "blocks")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    # At most one row per source, then one per slot of the period: both bounded by MAX_PERIOD.
    placed = (
        docs.join(F.broadcast(per_source), docs["source"].eqNullSafe(F.col("_source")))
        .withColumn("block", hashed.cast("long") % F.col("blocks"))
        .select("row", "source", "q", "weight", "block", (F.col("block") % F.col("weight")).alias("_at"))
    )
    slots = period.select("_source", "_k", "_slot")
    return (
        placed.join(F.broadcast(slots), placed["source"].eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_k")))
        .select(
            *[F.col("row").getField(c).alias(c) for c in kept],
            "weight",
            "block",
            (F.floor(F.col("block") / F.col("weight")) * F.col("q") + F.col("_slot")).alias("slot"),
            F.floor(F.col("block") * F.col("q") / F.col("weight")).alias("release"),
            F.ceil((F.col("block") + 1) * F.col("q") / F.col("weight")).alias("deadline"),
        )
    )


def in_slot_order(mix: DataFrame) -> DataFrame:
    """Rows ranged over files in the order of the stream."""
    return mix.repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id")
