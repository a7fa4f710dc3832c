"""Hospital standard-charge files in JSON, versions 2 and 3."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.functions.clean import empty_if_null, null_if_empty
from ratelantern.schemas import HOSPITAL_DOCUMENT, HOSPITAL_HEADER, HOSPITAL_ITEM, MODIFIER
from ratelantern.sources.documents import array_elements, read_documents
from ratelantern.sources.elements import reshard


def read_hospital_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_documents(spark, path, HOSPITAL_DOCUMENT)


def file_format() -> Column:
    return (
        F.when(F.startswith("version", F.lit("2")), "json-v2")
        .when(F.startswith("version", F.lit("3")), "json-v3")
        .otherwise("json")
    )


def _meta() -> Column:
    location = F.coalesce("location_name", "hospital_location")
    confirmed = F.coalesce(
        "attestation.confirm_attestation", "affirmation.confirm_affirmation", F.lit(False)
    )
    return F.struct(
        empty_if_null(F.col("hospital_name")).alias("hospital_name"),
        empty_if_null(F.col("last_updated_on")).alias("last_updated_on"),
        empty_if_null(F.col("version")).alias("version"),
        empty_if_null(F.array_join(location, "; ")).alias("hospital_location"),
        empty_if_null(F.array_join("hospital_address", "; ")).alias("hospital_address"),
        F.col("license_information.license_number").alias("license_number"),
        null_if_empty(F.col("license_information.state")).alias("license_state"),
        confirmed.alias("affirmation"),
        F.col("type_2_npi").alias("npis"),
        F.col("attestation.attester_name").alias("attester_name"),
        file_format().alias("format"),
    ).alias("meta")


def items(documents: DataFrame) -> DataFrame:
    """One row per charge item, numbered from 1 within its file."""
    return documents.select(
        "source_file", _meta(), F.posexplode("standard_charge_information").alias("_at", "item")
    ).select("source_file", "meta", (F.col("_at") + 1).cast("bigint").alias("item_ord"), "item")


def modifiers(documents: DataFrame) -> DataFrame:
    return documents.select(
        "source_file",
        F.posexplode("modifier_information").alias("modifier_ord", "modifier"),
    )


def read_large_hospital_json(
    spark: SparkSession, path: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """(items, modifiers) of files too large to be one row."""
    elements = reshard(spark, path, ["standard_charge_information", "modifier_information"])
    item_rows = array_elements(
        elements, "standard_charge_information", HOSPITAL_ITEM, HOSPITAL_HEADER, "item"
    ).select("source_file", _meta(), F.col("ordinal").alias("item_ord"), "item")
    modifier_rows = elements.where(F.col("array_name") == "modifier_information").select(
        "source_file",
        (F.col("ordinal") - 1).cast("int").alias("modifier_ord"),
        F.from_json("element", MODIFIER, {"mode": "FAILFAST"}).alias("modifier"),
    )
    return item_rows, modifier_rows
