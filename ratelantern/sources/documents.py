"""JSON documents as rows: whole files, or elements of re-sharded files."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.session import write_stage
from ratelantern.sources.elements import HEADER

_OPTIONS = {"multiLine": "true", "mode": "FAILFAST"}


def read_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per ``.json`` or ``.json.gz`` file. Unknown fields are skipped while parsing,
    malformed files fail the job."""
    return (
        spark.read.schema(schema)
        .options(**_OPTIONS)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("source_file"))
    )


def parse_documents(texts: DataFrame, text: str, source_file: str, schema: str) -> DataFrame:
    """One row per document kept as text in column ``text``."""
    return texts.select(
        F.from_json(text, schema, {"mode": "FAILFAST"}).alias("_document"),
        F.col(source_file).alias("source_file"),
    ).select("_document.*", "source_file")


def array_elements(
    elements: DataFrame, array_name: str, schema: str, header_schema: str, column: str
) -> DataFrame:
    """Parsed elements of one array of re-sharded files, with the header of their file.

    Headers, one small row per file, get a table of their own: then Spark knows their size
    and broadcasts them only if they are small.
    """
    failfast: Mapping[str, str] = {"mode": "FAILFAST"}
    headers = write_stage(
        elements.where(F.col("array_name") == HEADER).select(
            "source_file", F.from_json("element", header_schema, failfast).alias("_header")
        ),
        f"{array_name}-headers",
    )
    parsed = elements.where(F.col("array_name") == array_name).select(
        "source_file", "ordinal", F.from_json("element", schema, failfast).alias(column)
    )
    return parsed.join(headers, "source_file").select(
        "source_file", "ordinal", column, "_header.*"
    )
