"""Hospital files -> charge rows, one common shape for tall CSV, wide CSV and JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.functions.clean import (
    empty_if_null,
    flexible_number,
    joined_modifiers,
    money,
    null_if_empty,
    repaired_utf8,
    text_or_empty,
    text_or_null,
)
from ratelantern.functions.codes import code_columns
from ratelantern.schemas import CHARGE_COLUMNS, CHARGE_EXTRAS

META_COLUMNS = [
    "hospital_name",
    "last_updated_on",
    "version",
    "hospital_location",
    "hospital_address",
    "license_number",
    "license_state",
    "affirmation",
    "financial_aid_policy",
    "general_contract_provisions",
]


def as_charges(df: DataFrame) -> DataFrame:
    """Give a frame all charge columns, in order and with their types; absent ones are null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in {**CHARGE_COLUMNS, **CHARGE_EXTRAS}.items()
        ]
    )


# --- CSV -------------------------------------------------------------------------------------
#
# Input: one row per data record with ``cells`` (array of text), ``layout`` (positions of the
# columns of that file, see sources.hospital_csv) and ``meta``. Positions differ per file, but
# the expressions do not, so files with different headers share one plan.


def _cell(field: str) -> Column:
    return F.get("cells", F.col(f"layout.{field}"))


def _text(field: str) -> Column:
    return text_or_null(repaired_utf8(_cell(field)))


def _slot_pairs() -> Column:
    """Filled code slots as (code, upper-case type), lowest slot number first."""
    pairs = F.transform(
        "layout.code_slots",
        lambda s: F.struct(
            text_or_null(F.get("cells", s["code"])).alias("code"),
            F.upper(text_or_null(F.get("cells", s["type"]))).alias("type"),
        ),
    )
    return F.filter(pairs, lambda p: p["code"].isNotNull() & p["type"].isNotNull())


def _payer_groups() -> Column:
    """Payer/plan groups of a wide record that hold any value."""

    def number(at: Column) -> Column:
        return money(F.get("cells", at))

    def text(at: Column) -> Column:
        return text_or_null(repaired_utf8(F.get("cells", at)))

    groups = F.transform(
        "layout.payer_groups",
        lambda g: F.struct(
            F.translate(g["payer"], "_", " ").alias("payer_name"),
            F.translate(g["plan"], "_", " ").alias("plan_name"),
            number(g["dollar"]).alias("negotiated_dollar"),
            number(g["percentage"]).alias("negotiated_percentage"),
            text(g["algorithm"]).alias("negotiated_algorithm"),
            number(g["estimate"]).alias("estimated_amount"),
            text(g["methodology"]).alias("methodology"),
            text(g["notes"]).alias("additional_payer_notes"),
        ),
    )
    values = [
        "negotiated_dollar",
        "negotiated_percentage",
        "negotiated_algorithm",
        "estimated_amount",
        "methodology",
        "additional_payer_notes",
    ]
    return F.filter(groups, lambda g: F.coalesce(*[g[v].cast("string") for v in values]).isNotNull())


def _common(records: DataFrame) -> DataFrame:
    return records.select(
        "source_file",
        "row_ord",
        "row_chunk",
        "cells",
        "layout",
        *[F.col("meta")[c].alias(c) for c in META_COLUMNS],
        text_or_empty(repaired_utf8(_cell("description"))).alias("description"),
        text_or_empty(repaired_utf8(_cell("setting"))).alias("setting"),
        money(_cell("gross")).alias("gross_charge"),
        money(_cell("discounted_cash")).alias("discounted_cash"),
        money(_cell("minimum")).alias("min_charge"),
        money(_cell("maximum")).alias("max_charge"),
        money(_cell("drug_unit")).alias("drug_unit_of_measurement"),
        _text("drug_type").alias("drug_type_of_measurement"),
        _text("modifiers").alias("modifiers"),
        _text("generic_notes").alias("additional_generic_notes"),
        _text("billing_class").alias("billing_class"),
        _slot_pairs().alias("_pairs"),
    ).select("*", *code_columns(F.col("_pairs")))


def tall_charges(records: DataFrame) -> DataFrame:
    """Tall records map one to one."""
    return as_charges(
        _common(records.where("layout.kind = 'tall'"))
        .withColumn("payer_name", _text("payer_name"))
        .withColumn("plan_name", _text("plan_name"))
        .withColumn("negotiated_dollar", money(_cell("negotiated_dollar")))
        .withColumn("negotiated_percentage", money(_cell("negotiated_percentage")))
        .withColumn("negotiated_algorithm", _text("negotiated_algorithm"))
        .withColumn("estimated_amount", money(_cell("estimated_amount")))
        .withColumn("methodology", _text("methodology"))
    )


def wide_charges(records: DataFrame) -> DataFrame:
    """Wide records give one row per filled payer/plan group, or one row without payer."""
    common = _common(records.where("layout.kind = 'wide'"))
    # The cells are not carried along: they would be repeated for every payer.
    carried = [c for c in common.columns if c not in ("cells", "layout", "_pairs")]
    return as_charges(
        common.select(*carried, _payer_groups().alias("_groups"))
        .select(*carried, F.posexplode_outer("_groups").alias("payer_ord", "_payer"))
        .select(*carried, "payer_ord", "_payer.*")
    )


def csv_charges(records: DataFrame) -> DataFrame:
    return tall_charges(records).unionByName(wide_charges(records))


# --- JSON ------------------------------------------------------------------------------------


def _packed_order(item: str, charge: str, payer: str) -> Column:
    """27 bits of item and 18 each of charge and payer; positions that do not fit are an error."""
    payer_ord = F.coalesce(F.col(payer), F.lit(0))
    fits = (F.col(item) < 1 << 27) & (F.col(charge) < 1 << 18) & (payer_ord < 1 << 18)
    packed = (
        F.shiftleft(F.col(item).cast("bigint"), 36)
        + F.shiftleft(F.col(charge).cast("bigint"), 18)
        + payer_ord
    )
    too_many = F.raise_error(F.lit("more items, charges or payers than row_ord can hold"))
    return F.when(~fits, too_many.cast("bigint")).otherwise(packed)


def json_charges(items: DataFrame) -> DataFrame:
    """Items of version 2 or 3 documents -> item x standard charge x payer.

    A charge without payers gives one row, an item without charges none. ``items`` carries
    ``source_file``, ``item_ord``, ``meta`` and the struct ``item``.
    """
    pairs = F.transform(
        F.coalesce("item.code_information", F.array()),
        lambda c: F.struct(
            empty_if_null(c["code"]).alias("code"), F.upper(c["type"]).alias("type")
        ),
    )
    # Before each unfolding, the fields needed later are taken out of the nested value, so
    # an item is not copied onto its charges nor a charge with all payers onto each payer.
    per_item = items.select(
        "source_file",
        "item_ord",
        "meta",
        pairs.alias("_pairs"),
        empty_if_null(repaired_utf8(F.col("item.description"))).alias("description"),
        flexible_number(F.col("item.drug_information.unit")).alias("drug_unit_of_measurement"),
        null_if_empty(F.col("item.drug_information.type")).alias("drug_type_of_measurement"),
        F.col("item.standard_charges").alias("_charges"),
    ).select("*", *code_columns(F.col("_pairs")))
    of_item = [c for c in per_item.columns if c not in ("_pairs", "_charges")]
    per_charge = per_item.select(
        *of_item, F.posexplode("_charges").alias("_charge_ord", "charge")
    ).select(
        *of_item,
        "_charge_ord",
        empty_if_null(repaired_utf8(F.col("charge.setting"))).alias("setting"),
        F.coalesce(
            F.col("charge.gross_charge"), flexible_number(F.col("charge.gross_charges"))
        ).alias("gross_charge"),
        F.col("charge.discounted_cash").alias("discounted_cash"),
        F.col("charge.minimum").alias("min_charge"),
        F.col("charge.maximum").alias("max_charge"),
        joined_modifiers(F.col("charge.modifier_code")).alias("modifiers"),
        repaired_utf8(F.col("charge.additional_generic_notes")).alias("additional_generic_notes"),
        F.col("charge.payers_information").alias("_payers"),
    )
    of_charge = [c for c in per_charge.columns if c != "_payers"]
    per_payer = per_charge.select(
        *of_charge, F.posexplode_outer("_payers").alias("_payer_ord", "payer")
    )

    def payer_text(field: str) -> Column:
        """Required by the format: present payers without it have an empty text."""
        return F.when(
            F.col("payer").isNotNull(), empty_if_null(repaired_utf8(F.col("payer")[field]))
        )

    return as_charges(
        per_payer.select(
            "source_file",
            # Items are in file order; charges and payers keep their order within the item.
            _packed_order("item_ord", "_charge_ord", "_payer_ord").alias("row_ord"),
            F.shiftright("item_ord", 10).cast("bigint").alias("row_chunk"),
            *[F.col("meta")[c].alias(c) for c in META_COLUMNS[:8]],
            F.col("meta.npis").alias("npis"),
            F.col("meta.attester_name").alias("attester_name"),
            "description",
            "drug_unit_of_measurement",
            "drug_type_of_measurement",
            *CODE_COLUMNS.values(),
            "setting",
            "gross_charge",
            "discounted_cash",
            "min_charge",
            "max_charge",
            "modifiers",
            "additional_generic_notes",
            payer_text("payer_name").alias("payer_name"),
            payer_text("plan_name").alias("plan_name"),
            F.col("payer.standard_charge_dollar").alias("negotiated_dollar"),
            F.col("payer.standard_charge_percentage").alias("negotiated_percentage"),
            F.col("payer.standard_charge_algorithm").alias("negotiated_algorithm"),
            F.col("payer.estimated_amount").alias("estimated_amount"),
            null_if_empty(repaired_utf8(F.col("payer.methodology"))).alias("methodology"),
            repaired_utf8(F.col("payer.additional_payer_notes")).alias("additional_payer_notes"),
            F.col("payer.median_amount").alias("median_amount"),
            F.col("payer.`10th_percentile`").alias("percentile_10th"),
            F.col("payer.`90th_percentile`").alias("percentile_90th"),
            F.col("payer.count").alias("count"),
        )
    )


def input_counts(records: DataFrame) -> DataFrame:
    """(source_file, input_records): data records of CSV files, or items of JSON files, per file."""
    return records.groupBy("source_file").agg(F.count("*").alias("input_records"))


def conversion_stats(charges: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Rows, rows with a payer, and payer/plan pairs per file.

    ``inputs`` (source_file, input_records) adds what was read; files without any charge row then count 0.
    """
    stats = charges.groupBy("source_file").agg(
        F.count("*").alias("charge_rows"),
        F.count("payer_name").alias("payer_rows"),
        F.count_distinct("payer_name", "plan_name").alias("payer_plan_pairs"),
    )
    return stats if inputs is None else inputs.join(stats, "source_file", "left").fillna(0)
