"""In-network negotiated-rate files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.schemas import (
    IN_NETWORK_DOCUMENT,
    IN_NETWORK_ITEM,
    PROVIDER_REFERENCE,
    RATE_HEADER,
    RATE_HEADER_OPTIONAL,
    RATE_HEADER_REQUIRED,
)
from ratelantern.sources.documents import array_elements, read_documents
from ratelantern.sources.elements import reshard

_HEADER_FIELDS = RATE_HEADER_REQUIRED + RATE_HEADER_OPTIONAL


def read_in_network(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_documents(spark, path, IN_NETWORK_DOCUMENT)


def items(documents: DataFrame) -> DataFrame:
    return documents.select(
        "source_file",
        *_HEADER_FIELDS,
        F.posexplode("in_network").alias("_at", "item"),
    ).select(
        "source_file", *_HEADER_FIELDS, (F.col("_at") + 1).cast("bigint").alias("item_ord"), "item"
    )


def references(documents: DataFrame) -> DataFrame:
    return documents.select("source_file", F.explode("provider_references").alias("reference"))


def read_large_in_network(
    spark: SparkSession, path: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """(items, references) of files too large to be one row."""
    elements = reshard(spark, path, ["in_network", "provider_references"])
    item_rows = array_elements(elements, "in_network", IN_NETWORK_ITEM, RATE_HEADER, "item")
    reference_rows = elements.where(F.col("array_name") == "provider_references").select(
        "source_file",
        F.from_json("element", PROVIDER_REFERENCE, {"mode": "FAILFAST"}).alias("reference"),
    )
    return item_rows.withColumnRenamed("ordinal", "item_ord"), reference_rows
