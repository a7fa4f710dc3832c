"""Sharding with sampled splitters.

Records are ordered by (hash of text, id). A sample drawn in proportion to size gives quantile
boundaries that cut this order into ranges, several per shard; ranges that turn out overfull are
cut again at boundaries sampled inside them, down to single ids. Sizes and counts of the ranges
add up to exact offsets, so each task numbers only its own range, and a record's shard follows
from where it lies among all bytes: shards differ by no more than a record, or than a group of
equal texts that is kept together. The number of ranges grows with the rows.

* Law ``bytes``: sizes are near equal. Equal texts share a shard unless their group is larger
  than ``keep_together`` of a shard; larger groups are spread, so that sizes stay near equal.
* A null text has no bytes and crc32 0; a null id sorts first. Equal rows are counted
  once while ranges are made and get slots of their own in the end. An empty table gives an empty result.
* Only ``doc_id`` and ``text`` are read; other columns do not matter.
"""

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelantern.llm.common import pieces_for
from ratelantern.session import write_stage

RECORD_BYTES = 8
NO_ID = -(2**63)
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _records(docs: DataFrame) -> DataFrame:
    """Distinct records with their number of copies."""
    return (
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("key"),
        )
        .groupBy("doc_id", "size", "text_crc32", "key")
        .agg(F.count("*").alias("copies"))
        .withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    )


def _sample(records: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int, float]]:
    """(key, id, weight) of about ``wanted`` records, taken in proportion to size.

    Records of more than ``total / wanted`` bytes are always taken, so there are at most
    2 x ``wanted`` on average, whatever the table holds.
    """
    share = F.col("size") * F.col("copies") * F.lit(wanted / max(total, 1))
    chance = F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    taken = records.where(chance < share).select("key", "id", F.greatest(share, F.lit(1.0)).alias("w"))
    return sorted((r["key"], r["id"], r["w"]) for r in taken.collect())


def _quantiles(sample: list[tuple[int, int, float]], parts: int, by_id: bool) -> list[tuple[int, int]]:
    """Boundaries: a range starts at its boundary. By key alone unless ``by_id``."""
    step = sum(w for *_, w in sample) / parts if sample else 1
    found, reached, due = set(), 0.0, step
    for key, id_, weight in sample:
        if reached + weight >= due:
            found.add((key, id_ if by_id else NO_ID))
            while due <= reached + weight:
                due += step
        reached += weight
    return sorted(found)


def _in_ranges(records: DataFrame, boundaries: list[tuple[int, int]]) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series, id_: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(boundaries, x) for x in zip(key, id_, strict=True)], dtype="int32")

    return records.withColumn("range", range_of("key", "id"))


def shard(
    docs: DataFrame,
    shards: int = 24,
    ranges_per_shard: int = 8,
    sample_per_range: int = 32,
    keep_together: float = 0.02,
    overfull: float = 4.0,
    range_rows: int = 4_000_000,
) -> DataFrame:
    """One row per input row: its shard and its slot there, under law ``bytes``."""
    spark = docs.sparkSession
    records = write_stage(_records(docs), "shard-records")
    total, rows = records.agg(F.sum(F.col("size") * F.col("copies")), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    ranges = shards * max(ranges_per_shard, pieces_for(rows, shards * range_rows))
    most_together = int(total * keep_together / shards)
    boundaries = _quantiles(_sample(records, total, ranges * sample_per_range, 0), ranges, by_id=False)
    seed = 0
    while True:
        ranged = _in_ranges(records, boundaries)
        # One row per range; their number depends on parameters only.
        held = ranged.groupBy("range").agg(
            F.sum(F.col("size") * F.col("copies")).alias("bytes"),
            F.count("*").alias("rows"),
            F.sum("copies").alias("all"),
            F.max(F.col("size") * F.col("copies")).alias("largest"),
        )
        held = sorted(held.collect())
        # A single record can't be cut, so what counts is what lies beside the largest one.
        loads = {r["range"]: max((r["bytes"] - r["largest"]) * ranges / total, r["rows"] * ranges / rows) for r in held if r["rows"] > 1}
        heavy = {at: load for at, load in loads.items() if load > overfull}
        if not heavy:
            break
        seed += 1
        inside = ranged.where(F.col("range").isin(list(heavy)))
        more = set(boundaries)
        for by_rows in (False, True):
            weighed = inside.withColumn("size", F.lit(1)).withColumn("copies", F.lit(1)) if by_rows else inside
            amount = sum((r["rows"] if by_rows else r["bytes"]) for r in held if r["range"] in heavy)
            parts = sum(max(2, round(x)) for x in heavy.values())
            more |= set(_quantiles(_sample(weighed, amount, parts * sample_per_range, seed), parts, by_id=True))
        # A boundary inside a group that stays together moves to the start of the group.
        inner = sorted({key for key, id_ in more if id_ != NO_ID})
        sizes = records.where(F.col("key").isin(inner)).groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).collect()
        small = {r["key"] for r in sizes if r["bytes"] <= most_together}
        more = {(key, NO_ID if key in small else id_) for key, id_ in more}
        if more == set(boundaries):
            break
        boundaries = sorted(more)

    offsets, before_bytes, before_rows = [], 0, 0
    for r in held:
        offsets.append((r["range"], before_bytes, before_rows))
        before_bytes += r["bytes"]
        before_rows += r["all"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))
    run = W.partitionBy("range").orderBy("key", "id", "size", "text_crc32")
    group = W.partitionBy("range", "key")
    weight = F.col("size") * F.col("copies")
    placed = (
        ranged.repartition(len(held), "range")
        .withColumn("end", F.sum(weight).over(run))
        .withColumn("row_end", F.sum("copies").over(run))
        .withColumn("group_bytes", F.sum(weight).over(group))
        .withColumn("group_start", F.min(F.col("end") - weight).over(group))
        .join(offsets, "range")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    )
    together = F.col("group_bytes") <= F.lit(most_together)
    # Twice the middle of the record, or of its group, among all bytes.
    start = F.when(together, F.col("group_start")).otherwise(F.col("end") - weight + F.col("copy") * F.col("size"))
    middle = 2 * (F.col("bytes_before") + start) + F.when(together, F.col("group_bytes")).otherwise(F.col("size"))
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row_end") - F.col("copies") + F.col("copy")).alias("row"),
    )
    placed = write_stage(placed, "shard-placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
