"""Exact grouped quantiles with linear interpolation, safe for very large groups.

``percentile`` keeps all distinct values of a group in one task. So values are counted first
(partial aggregation, hashed on group and value). Groups with few distinct values then use
``percentile`` on the counts. For large ones a histogram with a fixed number of buckets per
group locates the wanted ranks, and only the buckets that hold such a rank are sorted.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per unit of ln(1 + |value|): each spans about 0.1 % of its values, and a double
# can fall into at most some 1.5 million of them.
_RESOLUTION = 1024


def _bucket(value: Column) -> Column:
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * _RESOLUTION)).cast("bigint")


# Distinct values up to which a group is left to one task.
_SMALL_GROUP = 200_000
# Limit of the list of large groups. Groups beyond it are computed like small ones, so this
# bounds the size of a broadcast and never a result.
_MAX_LARGE_GROUPS = 50_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    small_group: int = _SMALL_GROUP,
) -> DataFrame:
    """One row per group: its keys, ``n_values`` and one column per wanted quantile.

    Groups without a non-null value are absent; join the result with a left join.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_rows"))
    )
    large = F.broadcast(
        counts.groupBy(*keys)
        .agg(F.count("*").alias("_distinct"))
        .where(F.col("_distinct") > small_group)
        .orderBy(F.desc("_distinct"), *keys)
        .limit(_MAX_LARGE_GROUPS)
        .select(*keys)
    )
    names = list(wanted)
    of_small = (
        counts.join(large, keys, "left_anti")
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("n_values"),
            F.percentile("_value", list(wanted.values()), F.col("_rows")).alias("_quantiles"),
        )
        .select(*keys, "n_values", *[F.col("_quantiles")[i].alias(n) for i, n in enumerate(names)])
    )
    return of_small.unionByName(
        _histogram_quantiles(counts.join(large, keys, "left_semi"), keys, wanted)
    )


def _histogram_quantiles(
    counts: DataFrame, keys: list[str], wanted: Mapping[str, float]
) -> DataFrame:
    """Quantiles from (keys, _value, _rows) without bringing a group into one task."""
    counts = counts.withColumn("_bucket", _bucket(F.col("_value")))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    histogram = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(by_bucket))
        .withColumn("n_values", F.sum("_rows").over(Window.partitionBy(*keys)))
        .withColumn("_below", F.col("_upto") - F.col("_rows"))
    )
    last = F.col("n_values") - 1
    ranks = F.array(
        *[
            F.struct(
                F.lit(f"{name}:{end}").alias("name"),
                edge(last * F.lit(p)).cast("bigint").alias("rank"),
            )
            for name, p in wanted.items()
            for end, edge in (("low", F.floor), ("high", F.ceil))
        ]
    )
    targets = histogram.select(
        *keys,
        "_bucket",
        "_below",
        "n_values",
        F.filter(
            ranks, lambda r: (r["rank"] >= F.col("_below")) & (r["rank"] < F.col("_upto"))
        ).alias("_ranks"),
    ).where(F.size("_ranks") > 0)

    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_value")
    hits = (
        counts.join(targets, [*keys, "_bucket"])
        .withColumn("_end", F.col("_below") + F.sum("_rows").over(in_bucket))
        .select(
            *keys,
            "n_values",
            "_value",
            F.explode(
                F.filter(
                    "_ranks",
                    lambda r: (r["rank"] < F.col("_end"))
                    & (r["rank"] >= F.col("_end") - F.col("_rows")),
                )
            ).alias("_hit"),
        )
    )

    def at(name: str, end: str) -> Column:
        return F.max(F.when(F.col("_hit.name") == f"{name}:{end}", F.col("_value")))

    def interpolated(name: str, p: float) -> Column:
        position = (F.first("n_values") - 1) * F.lit(p)
        low, high = at(name, "low"), at(name, "high")
        # The weighted form that percentile() uses for small groups, so that both agree to the last bit.
        part = position - F.floor(position)
        weighted = (F.ceil(position) - position) * low + part * high
        return F.when((part == 0) | (low == high), low).otherwise(weighted)

    return hits.groupBy(*keys).agg(
        F.first("n_values").alias("n_values"),
        *[interpolated(name, p).alias(name) for name, p in wanted.items()],
    )
