"""Yearly hospital metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.schemas import PROFILE_METRICS


def metric_history(
    profiles: DataFrame, last_year: int, *keys: str, metrics: list[str] = PROFILE_METRICS
) -> DataFrame:
    """One row per key, metric and each of the five years up to ``last_year``; null if unknown.

    The years are looked up in the map of the row, so nothing is joined or shuffled.
    """
    named = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("by_year")) for m in metrics]
    )
    return (
        profiles.select(*keys, F.inline(named))
        .select(
            *keys, "metric", "by_year", F.explode(F.sequence(F.lit(last_year - 4), F.lit(last_year))).alias("year")
        )
        .select(
            *keys,
            "metric",
            "year",
            F.try_element_at("by_year", F.col("year").cast("string")).alias("value"),
        )
    )


def metric_range(history: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest known value per key and metric."""
    return history.groupBy(*keys, "metric").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
