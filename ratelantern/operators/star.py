"""Charge rows -> the relational star.

Every id is a hash of what makes the row unique, so parents and children get matching ids by
projection alone: no sequence, no look-up and no ordering between the tables is needed, and
loading a file again yields the same ids. Ids have 128 bits, which keeps collisions out of
reach for any number of items.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelantern.functions.clean import (
    empty_if_null,
    fixed_text,
    null_if_empty,
    parsed_date,
    repaired_utf8,
    single_value_array,
    split_modifiers,
)
from ratelantern.fixed_values import CODE_COLUMNS
from ratelantern.functions.codes import code_text, unpivot_codes
from ratelantern.operators.ordered import mark_nested_runs

STAR_TABLES = [
    "hospitals",
    "codes",
    "plans",
    "payers",
    "standard_charge_items",
    "item_codes",
    "standard_charges",
    "payer_charges",
]

_SEPARATOR = "\x1f"


def hash_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws(_SEPARATOR, *[empty_if_null(p) for p in parts]).cast("binary"))


def packed_ids(df: DataFrame, *names: str) -> DataFrame:
    """Ids of ``hash_id`` as the 16 bytes they stand for, in the same order: half as long where rows are moved."""
    return df.withColumns({c: F.unhex(c) for c in names})


def unpacked_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in names})


def loaded_text(c: Column) -> Column:
    """Text as stored in the star: damaged bytes become a space."""
    return repaired_utf8(c, " ")


def item_key() -> list[Column]:
    """Rows of one file with equal values here describe one item."""
    return [
        F.col("description"),
        code_text(),
        fixed_text(F.col("drug_unit_of_measurement"), 4),
        F.col("drug_type_of_measurement"),
    ]


def charge_key() -> list[Column]:
    """Rows of one item with equal values here describe one standard charge."""
    amounts = ["gross_charge", "discounted_cash", "min_charge", "max_charge"]
    return [
        F.col("setting"),
        *[fixed_text(F.col(a), 6) for a in amounts],
        F.col("modifiers"),
        F.col("additional_generic_notes"),
    ]


def payer_ids() -> dict[str, Column]:
    """Ids of a row's payer and plan, which follow from their names."""
    payer_name = loaded_text(F.col("payer_name"))
    plan_name = empty_if_null(loaded_text(F.col("plan_name")))
    return {
        "payer_id": F.when(payer_name.isNotNull(), hash_id(payer_name)),
        "plan_id": F.when(payer_name.isNotNull(), hash_id(plan_name)),
    }


def with_ids(charges: DataFrame, grouping: str = "key") -> DataFrame:
    """Add the ids of all parents to each charge row.

    ``grouping="key"``: equal keys anywhere in a file are one item, found without a shuffle.
    ``grouping="adjacent"``: only neighbouring rows are grouped, in file order.
    """
    hospital_id = hash_id(F.col("source_file"))
    if grouping == "key":
        item_run = charge_run = F.lit("")
    elif grouping == "adjacent":
        charges = charges.withColumn("_item", hash_id(*item_key())).withColumn(
            "_charge", hash_id(F.col("_item"), *charge_key())
        )
        charges = packed_ids(charges, "_item", "_charge")  # only compared
        levels = {"_item_run": ["_item"], "_charge_run": ["_item", "_charge"]}
        charges = mark_nested_runs(
            charges, ["source_file"], ["row_chunk", "row_ord"], levels, F.col("row_chunk")
        )
        item_run, charge_run = F.col("_item_run").cast("string"), F.col("_charge_run").cast("string")
    else:
        raise ValueError(f"unknown grouping {grouping!r}")
    return (
        charges.withColumn("hospital_id", hospital_id)
        .withColumn("item_id", hash_id(F.col("hospital_id"), item_run, *item_key()))
        .withColumn("standard_charge_id", hash_id(F.col("item_id"), charge_run, *charge_key()))
        .withColumns(payer_ids())
        .drop("_item", "_charge", "_item_run", "_charge_run")
    )


def _first_row(df: DataFrame, key: str, *columns: Column, ids: Sequence[str] = ()) -> DataFrame:
    """The values of the earliest row per key; merged map-side, so a hot key stays cheap. ``ids`` among them are moved as bytes, as the key is."""
    picked = F.min_by(F.struct(*columns), F.struct("row_ord")).alias("_row")
    return unpacked_ids(packed_ids(df, key, *ids).groupBy(key).agg(picked).select(key, "_row.*"), key, *ids)


def hospitals(rows: DataFrame, load_date: str | None = None) -> DataFrame:
    """One hospital per source file, described by its first row.

    ``load_date`` (yyyy-MM-dd) stands in for a date that is missing or can't be parsed; without it the date is null.
    """
    return _first_row(
        rows,
        "hospital_id",
        F.col("source_file"),
        loaded_text(F.col("hospital_name")).alias("name"),
        single_value_array(loaded_text(F.col("hospital_address"))).alias("addresses"),
        single_value_array(loaded_text(F.col("hospital_location"))).alias("location_names"),
        F.col("npis"),
        null_if_empty(loaded_text(F.col("license_number"))).alias("license_number"),
        null_if_empty(loaded_text(F.col("license_state"))).alias("license_state"),
        loaded_text(F.col("version")).alias("version"),
        F.coalesce(parsed_date(F.col("last_updated_on")), F.lit(load_date).cast("date")).alias("last_updated_on"),
        F.col("attester_name"),
    )


def items(rows: DataFrame) -> DataFrame:
    return _first_row(
        rows,
        "item_id",
        F.col("hospital_id"),
        loaded_text(F.col("description")).alias("description"),
        F.col("drug_unit_of_measurement").alias("drug_unit"),
        null_if_empty(loaded_text(F.col("drug_type_of_measurement"))).alias("drug_unit_type"),
        ids=["hospital_id"],
    )


def code_id() -> Column:
    return hash_id(F.col("code"), F.col("code_type"))


def item_codes(rows: DataFrame) -> DataFrame:
    """Item-code links without repeats.

    An item's codes are part of its key, so repeats go before the codes are unfolded and the
    links need no second pass.
    """
    per_item = rows.select("item_id", *CODE_COLUMNS.values()).distinct()
    return unpivot_codes(per_item, "item_id").select("item_id", code_id().alias("code_id"))


def codes(rows: DataFrame) -> DataFrame:
    return unpivot_codes(rows).distinct().select(
        code_id().alias("code_id"), "code", "code_type"
    )


def payers(rows: DataFrame) -> DataFrame:
    named = rows.where(F.col("payer_name").isNotNull())
    return named.select("payer_id", loaded_text(F.col("payer_name")).alias("name")).distinct()


def plans(rows: DataFrame) -> DataFrame:
    named = rows.where(F.col("payer_name").isNotNull())
    name = empty_if_null(loaded_text(F.col("plan_name")))
    return named.select("plan_id", name.alias("name")).distinct()


def _charge_values() -> list[Column]:
    return [
        F.col("setting"),
        F.col("gross_charge"),
        F.col("discounted_cash"),
        F.col("min_charge").alias("minimum"),
        F.col("max_charge").alias("maximum"),
        split_modifiers(F.col("modifiers")).alias("modifier_codes"),
        null_if_empty(loaded_text(F.col("additional_generic_notes"))).alias("additional_notes"),
    ]


def standard_charges(rows: DataFrame) -> DataFrame:
    return _first_row(rows, "standard_charge_id", F.col("item_id"), *_charge_values(), ids=["item_id"])


def _payer_values() -> list[Column]:
    return [
        F.col("payer_id"),
        F.col("plan_id"),
        empty_if_null(loaded_text(F.col("methodology"))).alias("methodology"),
        F.col("negotiated_dollar").alias("standard_charge_dollar"),
        F.col("negotiated_percentage").alias("standard_charge_percentage"),
        null_if_empty(loaded_text(F.col("negotiated_algorithm"))).alias("standard_charge_algorithm"),
        F.col("estimated_amount"),
        F.col("median_amount"),
        F.col("percentile_10th"),
        F.col("percentile_90th"),
        F.col("count"),
        null_if_empty(loaded_text(F.col("additional_payer_notes"))).alias("additional_notes"),
    ]


def _payer_charge_id() -> Column:
    return hash_id(
        F.col("standard_charge_id"), F.col("payer_id"), F.col("plan_id"),
        F.col("row_ord").cast("string"), F.col("payer_ord").cast("string"),
    )


def payer_charges(rows: DataFrame) -> DataFrame:
    """One row per charge row with a payer; a projection, no shuffle."""
    return rows.where(F.col("payer_name").isNotNull()).select(
        _payer_charge_id().alias("payer_charge_id"), "standard_charge_id", *_payer_values()
    )


# --- joins of the star's tables, read off the charge rows they are made from ---------------------


def described_hospitals(rows: DataFrame) -> DataFrame:
    """(code, code_type, description, hospital_id) of the items' codes, some more than once.

    A description is part of its item's key, so it is that of each row. Only an empty one may be null in some rows
    of the item; there the first row decides.
    """
    text = loaded_text(F.col("description"))
    columns = ["hospital_id", "description", *CODE_COLUMNS.values()]
    named = rows.where(F.col("description") != "").withColumn("description", text).select(columns)
    unnamed = rows.where(empty_if_null(F.col("description")) == "")
    codes_of = unnamed.select("item_id", *CODE_COLUMNS.values()).distinct()
    first = items(unnamed).select("item_id", "hospital_id", "description").join(codes_of, "item_id").select(columns)
    return unpivot_codes(named.unionByName(first), "hospital_id", "description")


#: Values of a charge, as its first row gives them, and of a payer charge.
_OF_CHARGE = ["setting", "gross_charge", "discounted_cash", "min_charge", "max_charge", "modifiers", "additional_generic_notes"]
_OF_PAYER = ["payer_name", "plan_name", "methodology", "negotiated_dollar", "negotiated_percentage", "negotiated_algorithm", "estimated_amount",
             "median_amount", "percentile_10th", "percentile_90th", "count", "additional_payer_notes", "payer_ord"]
_ITEM_IDS = ("item_id", "standard_charge_id", "hospital_id")


def priced_columns(rows: DataFrame, *more: str) -> DataFrame:
    """What ``charges_with_payers`` needs of charge rows, ids as bytes; ids of payers and plans are made where the rows have met."""
    return packed_ids(rows.select(*_ITEM_IDS, "row_ord", "description", *_OF_CHARGE, *_OF_PAYER, *more), *_ITEM_IDS)


def charges_with_payers(rows: DataFrame) -> DataFrame:
    """Items, their charges and, if any, the payer charges of these, with payers' and plans' names and the items' codes.

    The same as the tables joined by their ids (codes stay in their columns), in one shuffle: the rows of an item meet, its
    first row describes it, the first one of a charge gives the charge, and rows with a payer are the payer charges.
    """
    return met_charges(priced_columns(rows, *CODE_COLUMNS.values()), *CODE_COLUMNS.values())


def met_charges(rows: DataFrame, *kept: str, of: Sequence[str] = ()) -> DataFrame:
    """``charges_with_payers`` of ``priced_columns``, with the columns ``kept`` of each row.

    Rows of an item meet by their id and the columns ``of``, so rows that were dealt by ranges of these are not moved again.
    """
    of_item = Window.partitionBy(*of, "item_id")
    of_charge = Window.partitionBy(*of, "item_id", "standard_charge_id")
    has_payer = F.col("payer_name").isNotNull()
    # One sort does: by charge and row, which also brings the rows of an item together. ``_at`` keeps the windows in this order.
    met = (
        rows.withColumn("_charge", F.first(F.struct(*_OF_CHARGE)).over(of_charge.orderBy("row_ord")))
        .withColumn("_at", F.row_number().over(of_charge.orderBy("row_ord")))
        .withColumn("_paid", F.max(has_payer).over(of_charge))
        .withColumn("_description", F.min_by("description", F.struct("row_ord", "_at")).over(of_item))
        .where(has_payer | (~F.col("_paid") & (F.col("_at") == 1)))
    )
    first = unpacked_ids(met, *_ITEM_IDS).withColumns({"description": F.col("_description")} | {c: F.col(f"_charge.{c}") for c in _OF_CHARGE})
    first = first.withColumns(payer_ids())
    charge, payer = _charge_values(), _payer_values()

    def if_paid(c: Column, name: str) -> Column:
        return F.when(has_payer, c).alias(name)

    paid = ["payer_id", "plan_id", "methodology", "standard_charge_dollar", "standard_charge_percentage", "standard_charge_algorithm",
            "estimated_amount", "median_amount", "percentile_10th", "percentile_90th", "count", "payer_notes"]
    return first.select(
        "item_id",
        "hospital_id",
        loaded_text(F.col("description")).alias("description"),
        "standard_charge_id",
        *charge[:-1],
        charge[-1].alias("charge_notes"),
        if_paid(_payer_charge_id(), "payer_charge_id"),
        *[if_paid(c, name) for c, name in zip(payer, paid, strict=True)],
        if_paid(loaded_text(F.col("payer_name")), "payer_name"),
        if_paid(empty_if_null(loaded_text(F.col("plan_name"))), "plan_name"),
        *kept,
    )


def build_star(
    charges: DataFrame, grouping: str = "key", skip_payer_charges: bool = True, load_date: str | None = None
) -> dict[str, DataFrame]:
    """All tables of the star. Payer tables stay empty unless asked for.

    ``charges`` may carry the ids already (stored with them, they are computed once).
    """
    rows = charges if "item_id" in charges.columns else with_ids(charges, grouping)
    payer_rows = rows.where(F.lit(False)) if skip_payer_charges else rows
    return {
        "hospitals": hospitals(rows, load_date),
        "codes": codes(rows),
        "plans": plans(payer_rows),
        "payers": payers(payer_rows),
        "standard_charge_items": items(rows),
        "item_codes": item_codes(rows),
        "standard_charges": standard_charges(rows),
        "payer_charges": payer_charges(payer_rows),
    }


# --- modifiers -----------------------------------------------------------------------------


def modifier_tables(modifiers: DataFrame) -> dict[str, DataFrame]:
    """``modifiers`` and ``modifier_payer_info`` from rows of (source_file, modifier_ord,
    modifier)."""
    rows = modifiers.select(
        "*",
        hash_id(F.col("source_file")).alias("hospital_id"),
        hash_id(F.col("source_file"), F.col("modifier_ord").cast("string")).alias("modifier_id"),
    )
    info = rows.select(
        "modifier_id", F.explode("modifier.modifier_payer_information").alias("_info")
    )
    return {
        "modifiers": rows.select(
            "modifier_id",
            "hospital_id",
            F.col("modifier.code").alias("code"),
            F.col("modifier.description").alias("description"),
            F.col("modifier.setting").alias("setting"),
        ),
        "modifier_payer_info": info.select(
            "modifier_id",
            F.col("_info.payer_name").alias("payer_name"),
            hash_id(F.col("_info.plan_name")).alias("plan_id"),
            F.col("_info.description").alias("description"),
        ),
    }


# --- loading into existing tables -----------------------------------------------------------


def upsert_dimension(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows plus the incoming ones whose key is new, each once."""
    new = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new.select(existing.columns))


def replace_sources(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows of other sources plus all incoming rows, so a reload replaces."""
    reloaded = incoming.select(key).distinct()
    return existing.join(reloaded, key, "left_anti").select(incoming.columns).unionByName(incoming)


# --- moving payer names into their own table --------------------------------------------------


def payers_from(*tables: DataFrame) -> DataFrame:
    """Distinct payer names of all tables, with their ids."""
    names = tables[0].select("payer_name")
    for table in tables[1:]:
        names = names.unionByName(table.select("payer_name"))
    names = names.where(F.col("payer_name").isNotNull()).distinct()
    return names.select(
        hash_id(F.col("payer_name")).alias("payer_id"), F.col("payer_name").alias("name")
    )


def missing_payers(table: DataFrame, payer_dim: DataFrame) -> DataFrame:
    """Payer names of ``table`` that the dimension does not have yet."""
    names = table.select(F.col("payer_name").alias("name")).where("name is not null").distinct()
    return names.join(payer_dim.select("name"), "name", "left_anti")


def names_to_ids(table: DataFrame, payer_dim: DataFrame) -> DataFrame:
    """Replace ``payer_name`` by ``payer_id``."""
    dim = payer_dim.select("payer_id", F.col("name").alias("payer_name"))
    return table.join(dim, "payer_name").drop("payer_name")


def ids_to_names(table: DataFrame, payer_dim: DataFrame) -> DataFrame:
    """Undo ``names_to_ids``."""
    dim = payer_dim.select("payer_id", F.col("name").alias("payer_name"))
    return table.join(dim, "payer_id").drop("payer_id")
