"""Tables of contents: plans and the rate files they point to.

Input everywhere: one row per reporting structure (see ``sources.toc.structures``). Plans
and URLs sit in the same row, so no join is needed to bring them together.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern.functions.clean import empty_if_null
from ratelantern.functions.predicates import PlanFilter, plan_description, plan_matches

PLAN_FIELDS = ["plan_name", "plan_id_type", "plan_id", "plan_market_type", "issuer_name"]


def _matched(wanted: PlanFilter) -> Column:
    return F.filter("reporting_plans", lambda p: plan_matches(lambda f: p[f], wanted))


def _count(items: Column) -> Column:
    return F.greatest(F.size(items), F.lit(0)).cast("bigint")


def _urls() -> Column:
    locations = F.transform("in_network_files", lambda f: empty_if_null(f["location"]))
    return F.coalesce(locations, F.array().cast("array<string>"))


def _plan_columns() -> list[Column]:
    plan = F.col("plan")
    return [
        *[empty_if_null(plan[f]).alias(f) for f in PLAN_FIELDS],
        plan_description(lambda f: plan[f]).alias("description"),
    ]


def plans(structures: DataFrame, wanted: PlanFilter = PlanFilter()) -> DataFrame:
    """One row per matched plan with the rate-file URLs of its structure."""
    exploded = structures.select(
        "source_file", "structure_id", F.explode(_matched(wanted)).alias("plan"),
        _urls().alias("in_network_urls"),
    )
    return exploded.select(
        "source_file",
        "structure_id",
        *_plan_columns(),
        "in_network_urls",
        F.size("in_network_urls").alias("url_count"),
    )


def normalised_plans(structures: DataFrame, wanted: PlanFilter = PlanFilter()) -> DataFrame:
    """Matched plans that refer to their structure instead of repeating its URLs.

    URLs are not even read, so plans are unfolded first and filtered in compiled code.
    """
    exploded = structures.select(
        "source_file",
        F.col("structure_id").alias("reporting_structure_id"),
        F.explode("reporting_plans").alias("plan"),
    )
    return exploded.where(plan_matches(lambda f: F.col("plan")[f], wanted)).select(
        "source_file", "reporting_structure_id", *_plan_columns()
    )


def plan_urls(structures: DataFrame, wanted: PlanFilter = PlanFilter()) -> DataFrame:
    """URLs of every structure with a matched plan, once per structure, duplicates kept."""
    return structures.where(
        F.exists("reporting_plans", lambda p: plan_matches(lambda f: p[f], wanted))
    ).select(
        "source_file",
        F.col("structure_id").alias("reporting_structure_id"),
        F.posexplode(_urls()).alias("url_ord", "url"),
    )


def toc_stats(structures: DataFrame, wanted: PlanFilter = PlanFilter()) -> DataFrame:
    """Structures and plans seen and matched, per file."""
    matched = _count(_matched(wanted))
    return structures.groupBy("source_file").agg(
        F.count("*").alias("total_structures"),
        F.sum(_count(F.col("reporting_plans"))).alias("total_plans"),
        F.count_if(matched > 0).alias("matched_structures"),
        F.sum(matched).alias("matched_plans"),
    )
