"""Price comparison across hospitals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern.functions.clean import display_price, display_price_kind, first_or_empty
from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.functions.codes import unpivot_codes
from ratelantern.operators.quantiles import exact_quantiles
from ratelantern.operators.star import charges_with_payers, code_id
from ratelantern.plans.search import Star

PRICE_COLUMNS = [
    "hospital_id",
    "setting",
    "gross_charge",
    "discounted_cash",
    "minimum",
    "maximum",
    "payer_name",
    "plan_name",
    "negotiated_dollar",
    "methodology",
    "estimated_amount",
]


def selected_charges(star: Star, code: str | None = None, code_type: str | None = None) -> DataFrame:
    """codes -> links -> items -> charges, LEFT payer charges, payers and plans.

    With laid-out tables (``sinks.gold``) this is a filter on the one sorted by code. With the ``charge_rows`` that a
    star is made from, its tables are not joined: the rows of each item meet once, and its codes are unfolded last.

    Codes are filtered first and everything else follows by equi-joins on ids; which sides are
    small enough to broadcast is left to the optimizer, hot ids to adaptive skew handling.
    """
    if "code_prices" in star:
        wanted = {name: value for name, value in (("code", code), ("code_type", code_type)) if value is not None}
        rows = star["code_prices"].where("code is not null and code_type is not null and hospital_id is not null")
        for name, value in wanted.items():
            rows = rows.where(F.col(name) == value)
        return rows
    if "charge_rows" in star:
        rows = charges_with_payers(star["charge_rows"]).withColumnRenamed("standard_charge_dollar", "negotiated_dollar")
        kept = [c for c in rows.columns if c not in CODE_COLUMNS.values()]
        rows = unpivot_codes(rows, *kept).withColumn("code_id", code_id())
        if code is not None:
            rows = rows.where(F.col("code") == code)
        if code_type is not None:
            rows = rows.where(F.col("code_type") == code_type)
        return in_order(rows, ["code_id", "code", "code_type"])
    # Never null in the star; saying so here keeps every use of the result the same to the
    # optimizer, so several uses in one query share their shuffles.
    codes = star["codes"].where("code is not null and code_type is not null")
    items = star["standard_charge_items"].where("hospital_id is not null")
    if code is not None:
        codes = codes.where(F.col("code") == code)
    if code_type is not None:
        codes = codes.where(F.col("code_type") == code_type)
    charges = star["standard_charges"].withColumnRenamed("additional_notes", "charge_notes")
    payer_charges = star["payer_charges"].withColumnsRenamed(
        {
            "standard_charge_dollar": "negotiated_dollar",
            "additional_notes": "payer_notes",
        }
    )
    described = items.select("item_id", "hospital_id", "description")
    linked = star["item_codes"].join(codes, "code_id")
    if code is None and code_type is None:
        # Every code is wanted: charges get their payer charges first, as each would be moved once per code of its item otherwise.
        priced = charges.join(payer_charges, "standard_charge_id", "left").join(described, "item_id")
        rows = priced.join(linked, "item_id")
    else:
        rows = linked.join(described, "item_id").join(charges, "item_id").join(payer_charges, "standard_charge_id", "left")
    named = rows.join(star["payers"].withColumnRenamed("name", "payer_name"), "payer_id", "left").join(
        star["plans"].withColumnRenamed("name", "plan_name"), "plan_id", "left"
    )
    return in_order(named, [c for c in linked.columns if c != "item_id"])


def in_order(rows: DataFrame, of_code: list[str]) -> DataFrame:
    first = ["plan_id", "payer_id", "standard_charge_id", "item_id", *of_code, "hospital_id", "description"]
    return rows.select(*first, *(c for c in rows.columns if c not in first))


def with_hospital(df: DataFrame, hospitals: DataFrame) -> DataFrame:
    lookup = hospitals.select(
        "hospital_id",
        F.col("name").alias("hospital_name"),
        first_or_empty(F.col("addresses")).alias("hospital_address"),
    )
    return df.join(lookup, "hospital_id")


def price_tuples(star: Star, code: str | None = None, code_type: str | None = None) -> DataFrame:
    """Distinct price rows of a code, or of every code when none is given.

    Name and address follow from the hospital id and are added when groups are small.
    """
    rows, keys = selected_charges(star, code, code_type), []
    if code is None:
        # Dealt by what all later groups of a comparison share, so its prices of all codes are moved once.
        keys = ["code", "code_type"]
        rows = rows.select(*keys, *PRICE_COLUMNS).repartition(*_keys(code))
    # ``estimate`` repeats a grouping column as an aggregate: conditions on it stay above the
    # shuffle, so the uses of this frame within one query share that shuffle.
    return rows.groupBy(*keys, *PRICE_COLUMNS).agg(F.max("estimated_amount").alias("estimate"))


def _nulls_last(name: str) -> list[Column]:
    return [F.col(name).isNull().alias(f"_no_{name}"), F.col(name)]


def _keys(code: str | None) -> list[str]:
    return (["code", "code_type"] if code is None else []) + ["hospital_id"]


def _best(tuples: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in PRICE_COLUMNS if c != "hospital_id"]
    # Lowest cash, then lowest gross; the remaining columns only make ties deterministic. All columns are in it, so
    # the smallest one is the row itself.
    rank = F.struct(
        *_nulls_last("discounted_cash"),
        *_nulls_last("gross_charge"),
        *[F.col(c) for c in others if c not in ("discounted_cash", "gross_charge")],
    )
    return (
        tuples.groupBy(*keys)
        .agg(F.min(rank).alias("_best"), F.count("estimate").alias("plan_count"))
        .select(*keys, *[f"_best.{c}" for c in others if c != "estimated_amount"], "plan_count")
    )


def best_prices(star: Star, code: str | None = None, code_type: str | None = None) -> DataFrame:
    """Per hospital the row with the lowest cash price and the number of estimates.

    With ``code=None`` the comparison is made for each code on its own.
    """
    best = _best(price_tuples(star, code, code_type), _keys(code))
    return with_hospital(best, star["hospitals"])


def compare_prices(
    star: Star, code: str | None = None, code_type: str | None = None
) -> DataFrame:
    """``best_prices`` with the median of the estimates of each hospital."""
    tuples, keys = price_tuples(star, code, code_type), _keys(code)
    medians = exact_quantiles(tuples, keys, "estimate", {"median_estimate": 0.5})
    compared = _best(tuples, keys).join(medians.drop("n_values"), keys, "left")
    return with_hospital(compared, star["hospitals"])


def by_price(prices: DataFrame) -> DataFrame:
    """Order of the comparison: cash, else gross, else last."""
    price = display_price(F.col("discounted_cash"), F.col("gross_charge"))
    return prices.orderBy(price.asc_nulls_last(), "hospital_id")


# Sort modes and the column each one uses.
SORT_COLUMNS = {
    "cash": "discounted_cash",
    "gross": "gross_charge",
    "median": "median_estimate",
}


def sorted_prices(prices: DataFrame, sort_by: str = "cash") -> DataFrame:
    column = SORT_COLUMNS.get(sort_by, "discounted_cash")
    return prices.orderBy(F.col(column).asc_nulls_last(), "hospital_id")


def _shown() -> Column:
    return display_price(F.col("discounted_cash"), F.col("gross_charge"))


def price_summary(prices: DataFrame, *keys: str) -> DataFrame:
    """Lowest and highest shown price and number of hospitals."""
    return prices.groupBy(*keys).agg(
        F.min(_shown()).alias("lowest_price"),
        F.max(_shown()).alias("highest_price"),
        F.count("*").alias("hospital_count"),
    )


def flag_lowest(prices: DataFrame, *keys: str) -> DataFrame:
    """Add the shown price, its kind and whether it is the lowest (of its keys).

    The lowest price is found by an aggregate, so no group is sorted in one task.
    """
    shown = prices.withColumn("display_price", _shown()).withColumn(
        "price_kind", display_price_kind(F.col("discounted_cash"), F.col("gross_charge"))
    )
    lowest = shown.groupBy(*keys).agg(F.min("display_price").alias("_lowest"))
    if keys:
        compared = shown.join(lowest, list(keys))
    else:
        compared = shown.withColumn("_lowest", lowest.scalar())
    return compared.withColumn(
        "is_lowest", F.coalesce(F.col("display_price") == F.col("_lowest"), F.lit(False))
    ).drop("_lowest")
