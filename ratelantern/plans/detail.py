"""Prices of one hospital in detail, or of all hospitals and codes at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.functions.clean import first_or_empty, payer_amount
from ratelantern.operators.quantiles import exact_quantiles
from ratelantern.operators.star import packed_ids, unpacked_ids
from ratelantern.plans.compare import selected_charges
from ratelantern.plans.search import Star

# The quantiles shown for payer amounts.
PERCENTILES = {"percentile_10th": 0.1, "percentile_50th": 0.5, "percentile_90th": 0.9}
PRICING_KEYS = ["hospital_id", "code", "code_type"]


def hospital_summary(star: Star, hospital_id: str | None = None) -> DataFrame:
    """Hospital attributes and whether it has inpatient or outpatient charges.

    Settings are merged per item, then per hospital, before hospitals are joined.
    """
    hospitals, items = star["hospitals"], star["standard_charge_items"]
    if hospital_id is not None:
        hospitals = hospitals.where(F.col("hospital_id") == hospital_id)
        items = items.where(F.col("hospital_id") == hospital_id)
    setting = F.lower("setting")
    per_item = packed_ids(star["standard_charges"], "item_id").groupBy("item_id").agg(
        F.bool_or(setting.isin("inpatient", "both")).alias("_in"),
        F.bool_or(setting.isin("outpatient", "both")).alias("_out"),
    )
    flags = (
        packed_ids(items, "item_id").select("item_id", "hospital_id")
        .join(per_item, "item_id")
        .groupBy("hospital_id")
        .agg(F.bool_or("_in").alias("_in"), F.bool_or("_out").alias("_out"))
    )
    return hospitals.join(flags, "hospital_id", "left").select(
        "hospital_id",
        F.col("name").alias("hospital_name"),
        first_or_empty(F.col("addresses")).alias("hospital_address"),
        "license_state",
        F.col("last_updated_on").cast("string").alias("last_updated_on"),
        F.coalesce("_in", F.lit(False)).alias("has_inpatient"),
        F.coalesce("_out", F.lit(False)).alias("has_outpatient"),
    )


def price_rows(
    star: Star,
    hospital_id: str | None = None,
    code: str | None = None,
    code_type: str | None = None,
) -> DataFrame:
    """Charges with their payer charges."""
    if "code_prices" in star:
        rows = selected_charges(star, code, code_type)
        return rows if hospital_id is None else rows.where(F.col("hospital_id") == hospital_id)
    scoped = dict(star)
    if hospital_id is not None:
        scoped["standard_charge_items"] = star["standard_charge_items"].where(
            F.col("hospital_id") == hospital_id
        )
    return selected_charges(scoped, code, code_type)


def in_detail_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(
        "setting",
        F.col("discounted_cash").asc_nulls_last(),
        F.col("gross_charge").asc_nulls_last(),
        F.col("payer_name").asc_nulls_last(),
        F.col("plan_name").asc_nulls_last(),
        "standard_charge_id",
        "payer_charge_id",
    )


def standard_charge_list(rows: DataFrame) -> DataFrame:
    """Each standard charge once, in the order of the detail view."""
    ids = ("hospital_id", "standard_charge_id")
    once = packed_ids(rows, *ids).select(
        *PRICING_KEYS,
        "standard_charge_id",
        "setting",
        "gross_charge",
        "discounted_cash",
        "minimum",
        "maximum",
        F.col("charge_notes").alias("notes"),
    ).dropDuplicates([*PRICING_KEYS, "standard_charge_id"])
    listed = once.orderBy(
        "setting",
        F.col("discounted_cash").asc_nulls_last(),
        F.col("gross_charge").asc_nulls_last(),
        "standard_charge_id",
    )
    return unpacked_ids(listed, *ids)


def payer_charge_list(rows: DataFrame) -> DataFrame:
    with_payer = rows.where(F.col("payer_charge_id").isNotNull())
    columns = [
        *PRICING_KEYS, "payer_charge_id", "standard_charge_id", "setting", "payer_name", "plan_name", "methodology",
        "negotiated_dollar", "estimated_amount", "median_amount", "percentile_10th", "percentile_90th", "count",
    ]
    ids = ("hospital_id", "payer_charge_id", "standard_charge_id")
    moved = packed_ids(with_payer, *ids).select(*columns, "discounted_cash", "gross_charge", "payer_notes")
    listed = in_detail_order(moved).select(*columns, F.col("payer_notes").alias("notes"))
    return unpacked_ids(listed, *ids)


def payer_percentiles(rows: DataFrame) -> DataFrame:
    """Percentiles of payer amounts per hospital and code."""
    amounts = rows.where(F.col("payer_charge_id").isNotNull()).select(
        *PRICING_KEYS,
        payer_amount(
            F.col("negotiated_dollar"), F.col("estimated_amount"), F.col("median_amount")
        ).alias("amount"),
    )
    return exact_quantiles(amounts, PRICING_KEYS, "amount", PERCENTILES)


def headline_price(rows: DataFrame) -> DataFrame:
    """First listed cash price, else first listed gross price, per hospital and code.

    The list is sorted by setting, cash, gross and id; the earliest row with a price is the
    smallest one in that order, so a minimum replaces the sort.
    """
    cash, gross = F.col("discounted_cash"), F.col("gross_charge")
    at = F.struct(
        "setting",
        cash.isNull().alias("_no_cash"),
        cash,
        gross.isNull().alias("_no_gross"),
        gross,
        F.unhex("standard_charge_id").alias("_id"),
    )
    return (
        rows.groupBy(*PRICING_KEYS)
        .agg(F.min(F.when(cash.isNotNull(), at)).alias("_cash"), F.min(F.when(gross.isNotNull(), at)).alias("_gross"))
        .select(*PRICING_KEYS, F.coalesce("_cash.discounted_cash", "_gross.gross_charge").alias("headline_price"))
    )
