"""Conformance report: rules of the published file formats as conditions that must not hold.

All rules of a table are evaluated in one pass and counted with one aggregate.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern import fixed_values as fixed
from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.functions.codes import has_code

Rules = Mapping[str, Column]


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _given(c: Column) -> Column:
    return ~_missing(c)


def _not_positive(*names: str) -> Column:
    bad = F.lit(False)
    for name in names:
        bad = bad | F.coalesce(F.col(name) <= 0, F.lit(False))
    return bad


def report(rows: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """(keys, rule, violations, checked_rows) for every rule."""
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("checked_rows"),
        *[F.count_if(condition).alias(f"r{i}") for i, condition in enumerate(rules.values())],
    )
    per_rule = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, name in enumerate(rules)
        ]
    )
    return counted.select(*keys, "checked_rows", F.inline(per_rule))


def violations(rows: DataFrame, rules: Rules) -> DataFrame:
    """The rows that break any rule, with the names of the rules."""
    broken = F.filter(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return rows.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def charge_rules() -> Rules:
    """Hospital charge rows: conditional requirements and value ranges."""
    negotiated = (
        F.col("negotiated_dollar").isNotNull()
        | F.col("negotiated_percentage").isNotNull()
        | _given(F.col("negotiated_algorithm"))
    )
    any_price = negotiated | F.col("gross_charge").isNotNull() | F.col("discounted_cash").isNotNull()
    no_code = ~has_code()
    notes = _given(F.col("additional_generic_notes")) | _given(F.col("additional_payer_notes"))
    unit, kind = F.col("drug_unit_of_measurement"), F.col("drug_type_of_measurement")
    modifier_only = _given(F.col("modifiers")) & no_code
    methodology = F.lower(F.replace("methodology", F.lit("_"), F.lit(" ")))
    return {
        "setting is known": ~F.lower("setting").isin(*fixed.SETTINGS) | _missing(F.col("setting")),
        "negotiated charge has payer, plan and methodology": negotiated
        & (
            _missing(F.col("payer_name"))
            | _missing(F.col("plan_name"))
            | _missing(F.col("methodology"))
        ),
        "charge has a code": any_price & no_code & ~_given(F.col("modifiers")),
        "other methodology has notes": (methodology == "other") & ~notes,
        "item has a price": ~any_price & ~modifier_only,
        "negotiated dollar has minimum and maximum": F.col("negotiated_dollar").isNotNull()
        & (F.col("min_charge").isNull() | F.col("max_charge").isNull()),
        "percentage or algorithm alone has an estimate": F.col("negotiated_dollar").isNull()
        & negotiated
        & F.col("estimated_amount").isNull(),
        "NDC has drug unit and type": _given(F.col("ndc_code")) & (unit.isNull() | _missing(kind)),
        "modifier alone has description and price or notes": modifier_only
        & (_missing(F.col("description")) | (~negotiated & ~notes)),
        "drug unit and type come together": unit.isNotNull() != _given(kind),
        "methodology is known": _given(methodology) & ~methodology.isin(*fixed.METHODOLOGIES),
        "billing class is known": _given(F.col("billing_class"))
        & ~F.lower("billing_class").isin(*fixed.CHARGE_BILLING_CLASSES),
        "numbers are positive": _not_positive(
            "gross_charge",
            "discounted_cash",
            "negotiated_dollar",
            "negotiated_percentage",
            "estimated_amount",
            "min_charge",
            "max_charge",
            "drug_unit_of_measurement",
        ),
        "date is valid": F.try_to_date("last_updated_on", "yyyy-MM-dd").isNull()
        & F.try_to_date("last_updated_on", "M/d/yyyy").isNull(),
    }


def version_3_rules() -> Rules:
    """Payer values only version 3 JSON has; rows of other versions break none of these rules."""
    is_v3 = F.coalesce(F.startswith("version", F.lit("3")), F.lit(False))
    inexact = F.col("negotiated_percentage").isNotNull() | _given(F.col("negotiated_algorithm"))
    count = F.col("count")
    amounts = F.array("median_amount", "percentile_10th", "percentile_90th")
    rules = {
        "percentage or algorithm has a count": inexact & _missing(count),
        "count above zero has median and percentiles": inexact
        & (F.coalesce(count, F.lit("")) != "0")
        & F.exists(amounts, lambda a: a.isNull()),
        "count of zero has notes": (count == "0") & _missing(F.col("additional_payer_notes")),
        "count has a valid form": _given(count) & ~count.rlike(fixed.COUNT_PATTERN),
        "amounts are positive": _not_positive("median_amount", "percentile_10th", "percentile_90th"),
    }
    return {name: is_v3 & condition for name, condition in rules.items()}


def csv_code_rules() -> Rules:
    """CSV records before codes become columns: a code and its type come together."""
    half = F.exists(
        "layout.code_slots",
        lambda s: (
            F.coalesce(F.btrim(F.get("cells", s["code"])), F.lit("")) != ""
        )
        != (F.coalesce(F.btrim(F.get("cells", s["type"])), F.lit("")) != ""),
    )
    unknown = F.exists(
        "layout.code_slots",
        lambda s: F.coalesce(
            ~F.upper(F.btrim(F.get("cells", s["type"]))).isin("", *CODE_COLUMNS), F.lit(False)
        ),
    )
    return {"code and code type come together": half, "code type is known": unknown}


def structure_rules() -> Rules:
    """Reporting structures of a table of contents."""
    def insecure(location: Column) -> Column:
        return ~F.coalesce(location, F.lit("")).rlike(fixed.URL_PATTERN)

    plans = F.coalesce("reporting_plans", F.array())

    def any_plan(condition) -> Column:
        return F.exists(plans, condition)

    return {
        "structure has plans": F.size(plans) == 0,
        "structure has files": (F.size(F.coalesce("in_network_files", F.array())) == 0)
        & F.col("allowed_amount_file").isNull(),
        "in-network locations are https": F.exists(
            F.coalesce("in_network_files", F.array()), lambda f: insecure(f["location"])
        ),
        "allowed-amount location is https": F.col("allowed_amount_file").isNotNull()
        & insecure(F.col("allowed_amount_file.location")),
        "plan id type is known": any_plan(
            lambda p: ~F.coalesce(p["plan_id_type"], F.lit("")).isin(*fixed.PLAN_ID_TYPES)
        ),
        "market type is known": any_plan(
            lambda p: ~F.coalesce(p["plan_market_type"], F.lit("")).isin(*fixed.MARKET_TYPES)
        ),
        "ein plan has a sponsor": any_plan(
            lambda p: (p["plan_id_type"] == "ein")
            & (F.coalesce(p["plan_sponsor_name"], F.lit("")) == "")
        ),
        "plan has name, id and issuer": any_plan(
            lambda p: (F.coalesce(p["plan_name"], F.lit("")) == "")
            | (F.coalesce(p["plan_id"], F.lit("")) == "")
            | (F.coalesce(p["issuer_name"], F.lit("")) == "")
        ),
    }


def rate_rules() -> Rules:
    """Rows of negotiated rates."""
    services = F.coalesce("service_code", F.array().cast("array<string>"))
    listed = F.forall(services, lambda s: s.rlike(fixed.SERVICE_CODE_PATTERN))
    custom = (F.size(services) == 1) & F.forall(
        services, lambda s: s.rlike(fixed.ANY_SERVICE_CODE_PATTERN)
    )
    plan_fields = ["plan_name", "plan_id_type", "plan_id", "plan_market_type", "issuer_name"]
    given = [F.col(f).isNotNull() for f in plan_fields]
    any_given, all_given = F.lit(False), F.lit(True)
    for g in given:
        any_given, all_given = any_given | g, all_given & g
    return {
        "arrangement is known": ~F.col("negotiation_arrangement").isin(*fixed.NEGOTIATION_ARRANGEMENTS),
        "billing code type is known": ~F.col("billing_code_type").isin(*fixed.RATE_CODE_TYPES),
        "negotiated type is known": ~F.col("negotiated_type").isin(*fixed.NEGOTIATED_TYPES),
        "billing class is known": ~F.col("billing_class").isin(*fixed.RATE_BILLING_CLASSES),
        "setting is known": ~F.col("setting").isin(*fixed.SETTINGS),
        "rate is positive": ~(F.col("negotiated_rate") > 0),
        "expiration date is a date": ~F.col("expiration_date").rlike(fixed.ISO_DATE_PATTERN),
        "professional rate has service codes": (F.col("billing_class") == "professional")
        & F.col("service_code").isNull(),
        "service codes are valid": ~(listed | custom),
        "plan fields come together": any_given & ~all_given,
        "ein plan has a sponsor": (F.col("plan_id_type") == "ein")
        & F.col("plan_sponsor_name").isNull(),
    }


def provider_rules() -> Rules:
    """Rows of provider groups and NPIs."""
    npi, kind, value = F.col("npi"), F.col("tin_type"), F.col("tin_value")
    return {
        "NPI has ten digits or is zero": ~(
            npi.between(1_000_000_000, 9_999_999_999) | (npi == 0)
        ),
        "TIN type is known": ~kind.isin("ein", "npi"),
        "EIN has its form": (kind == "ein") & ~value.rlike(fixed.EIN_PATTERN),
        "NPI as TIN has its form": (kind == "npi") & ~value.rlike(fixed.NPI_TIN_PATTERN),
        "EIN has a business name": (kind == "ein") & _missing(F.col("business_name")),
    }
