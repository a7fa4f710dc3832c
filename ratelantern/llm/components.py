"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.session import write_stage


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id that has a link (``a``, ``b``).

    Rounds hand each id's neighbours to its smallest neighbour, first the larger ones and then
    the others, until every id points at the smallest of its component. Each round is an aggregate and
    a join on ids, written to the shared folder; nothing of them comes to the driver but a checksum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = write_stage(edges, "links-0")
    before, turn = None, 0
    while True:
        turn += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # An id whose only neighbours are smaller keeps its link to the smallest of them.
        edges = larger.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = write_stage(edges, f"links-{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
