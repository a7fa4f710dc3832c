"""Table-of-contents files of health plans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.schemas import REPORTING_STRUCTURE, TOC_DOCUMENT, TOC_HEADER
from ratelantern.sources.documents import array_elements, read_documents
from ratelantern.sources.elements import reshard

HEADER_FIELDS = ["reporting_entity_name", "reporting_entity_type", "last_updated_on", "version"]


def read_toc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_documents(spark, path, TOC_DOCUMENT)


def structures(documents: DataFrame) -> DataFrame:
    """One row per reporting structure, numbered from 1 within its file."""
    return documents.select(
        "source_file",
        *HEADER_FIELDS,
        F.posexplode("reporting_structure").alias("_at", "_structure"),
    ).select(
        "source_file",
        *HEADER_FIELDS,
        (F.col("_at") + 1).cast("bigint").alias("structure_id"),
        "_structure.*",
    )


def read_large_structures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same rows for files too large to be one row."""
    elements = reshard(spark, path, ["reporting_structure"])
    return array_elements(
        elements, "reporting_structure", REPORTING_STRUCTURE, TOC_HEADER, "_structure"
    ).select(
        "source_file",
        *HEADER_FIELDS,
        F.col("ordinal").alias("structure_id"),
        "_structure.*",
    )
