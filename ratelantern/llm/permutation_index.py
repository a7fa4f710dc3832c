"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. The index deals vectors to shards;
in each shard every pivot has an inverted file with the place that the pivot takes in
each vector's order. A query adds up, pivot by pivot, how far the places differ (Spearman's
footrule; a pivot beyond the ``prefix`` counts as being at its end). The ``rerank`` share of a
shard's vectors with the smallest sums is compared with the query by cosine in double precision.

Up to ``pivots`` pivots, not close to each other, come from a sample of about four times as many
vectors, chosen by a hash of ids; all vectors are
indexed. Queries meet shards in blocks; only each block's best rows leave a task.

* Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part.
* A query's own row is not its neighbour; nor is another row with its id. Equal rows count once.
* Vectors of different length are never compared. Ties go to the smaller vec_id.
* ``label`` and other columns do not matter.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ratelantern.llm.common import pieces_for
from ratelantern.llm.vectors import matrix, sample_of, unit, vectors
from ratelantern.session import write_stage

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Vectors of a shard that are compared in any case.
LEAST_RERANKED = 256
#: Vectors with less than this part of a random footrule are always compared.
CLOSE = 0.5


def pivot_orders(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first."""
    return np.argsort(-(unit(rows) @ unit(pivots).T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def spread_pivots(rows: np.ndarray, pivots: int) -> np.ndarray:
    """The first ``pivots`` rows that are not close to one taken before."""
    normed = unit(rows)
    taken: list[int] = []
    for i in range(len(rows)):
        if len(taken) < pivots and (not taken or (normed[taken] @ normed[i]).max() < 0.9):
            taken.append(i)
    return rows[taken]


def search_shard(queries: np.ndarray, query_ids: np.ndarray, orders: np.ndarray, rows: np.ndarray, ids: np.ndarray, row_orders: np.ndarray, pivots: int, k: int, rerank: float):
    """(query, id, score) of the best rows of one shard for each query."""
    prefix = row_orders.shape[1]
    # Inverted files: for each pivot the place it takes in every vector.
    places = np.full((len(rows), pivots), prefix, dtype=np.int16)
    np.put_along_axis(places, row_orders.astype(np.int64), np.arange(prefix, dtype=np.int16)[None, :], axis=1)
    places = np.ascontiguousarray(places.T)
    normed, wanted = unit(rows), unit(queries)
    chosen = min(len(rows), max(LEAST_RERANKED, int(np.ceil(rerank * len(rows)))))
    apart, off = np.empty(len(rows), dtype=np.int32), np.empty(len(rows), dtype=np.int16)
    close = CLOSE * (pivots * pivots - 1) / 3  # of the mean footrule of two random orders
    found = []
    for q in range(len(queries)):
        apart[:] = 0
        for place, pivot in enumerate(orders[q].tolist()):
            np.subtract(places[pivot], place, out=off)
            np.abs(off, out=off)
            apart += off
        if chosen < len(rows):
            # All that are far closer than chance come on top, so that no group of close vectors is cut.
            near = np.nonzero((apart <= np.partition(apart, chosen - 1)[chosen - 1]) | (apart < close))[0]
        else:
            near = np.arange(len(rows))
        near = near[ids[near] != query_ids[q]]
        score = normed[near] @ wanted[q]
        best = np.lexsort((ids[near], -score))[:k]
        found += [(query_ids[q], ids[near[b]], score[b]) for b in best]
    return found


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 256, prefix: int = 256, rerank: float = 0.05
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of ``table`` found for each row of ``queries``."""
    spark = table.sparkSession
    rows = write_stage(vectors(table), "ann-vectors")
    asked = vectors(queries)
    total = rows.count()
    sample: dict[int, np.ndarray] = {}
    for r in sample_of(rows, 4 * pivots, total).select("vec_id", "vector", "dim").orderBy("vec_id").collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    sample = {dim: spread_pivots(np.array(found, dtype=np.float64), pivots) for dim, found in sample.items()}
    sent = spark.sparkContext.broadcast(sample)

    def ordered(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own = sent.value.get(int(dim), np.eye(int(dim)))
                orders = pivot_orders(matrix(part["vector"]), own, prefix)
                yield part.assign(order=list(orders))

    def indexed(frame: DataFrame) -> DataFrame:
        schema = T.StructType([*frame.schema.fields, T.StructField("order", T.ArrayType(T.ShortType()))])
        return frame.mapInPandas(ordered, schema)

    shards = pieces_for(total, SHARD_ROWS)
    # The index: every vector with its order of pivots, dealt to shards.
    index = write_stage(
        indexed(rows.select("vec_id", "vector", "dim")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), "ann-index"
    )
    asked = write_stage(indexed(asked.select("vec_id", "vector", "dim")), "ann-queries")
    blocks = pieces_for(asked.count(), QUERY_BLOCK)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asking):
            dim = int(own["dim"].iloc[0])
            count = len(sent.value.get(dim, np.eye(dim)))
            found = search_shard(
                matrix(asking["vector"]), asking["vec_id"].to_numpy(), np.array(list(asking["order"])), matrix(own["vector"]), own["vec_id"].to_numpy(), np.array(list(own["order"])), count, k, rerank
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["shard", "block", "dim"]
    met = (
        index.select("*", each_block)
        .groupBy(*keys)
        .cogroup(asked.select("*", block, each_shard).groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    # k rows per query and shard.
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
