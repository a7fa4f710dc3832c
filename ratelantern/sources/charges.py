"""Charge rows stored as Parquet: one file, or a directory of files."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ratelantern.operators.charges import as_charges
from ratelantern.operators.ordered import row_chunk
from ratelantern.schemas import CHARGE_COLUMNS, CHARGE_EXTRAS
from ratelantern.session import write_stage
from ratelantern.sinks.writers import write_charges
from ratelantern.sources.files import list_files

_FOOTER_SCHEMA = "source_file string, bytes bigint, rows_written bigint, error string"


def read_charges(
    spark: SparkSession, path: str | list[str], tolerate_corrupt_files: bool = False
) -> DataFrame:
    """Charge rows with their origin. Files written elsewhere carry no ``source_file`` or
    ``row_ord``; then the file itself is the source and the row position the order."""
    df = (
        spark.read.option("ignoreCorruptFiles", str(tolerate_corrupt_files).lower())
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )
    extra = []
    if "source_file" not in df.columns:
        extra.append(F.col("_metadata.file_path").alias("source_file"))
    if "row_ord" not in df.columns:
        at = F.col("_metadata.row_index")
        extra += [at.alias("row_ord"), row_chunk(at).alias("row_chunk")]
    return as_charges(df.select("*", *extra))


# --- loading a directory, file by file accounted for ------------------------------------------


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many rows each file says it holds, or why it can't be read. Only footers are read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        found = []
        for path, size in zip(batch["source_file"], batch["bytes"]):
            filesystem, inner = fs.FileSystem.from_uri(path)
            try:
                found.append((path, size, pq.read_metadata(inner, filesystem=filesystem).num_rows, None))
            except Exception as failure:  # whatever is wrong with a file goes to the ledger
                found.append((path, size, None, str(failure)[:500]))
        yield pd.DataFrame(found, columns=["source_file", "bytes", "rows_written", "error"]).astype({"rows_written": "Int64"})


def load_directory(spark: SparkSession, path: str | list[str], out: str, pattern: str = "*.parquet") -> DataFrame:
    """Write the charge rows of all files that can be read to ``out``/charges; return the ledger.

    The ledger has a row per listed file: charge_file, bytes, rows_written (by its footer), rows_loaded, outcome
    and error. A file is ``loaded``, ``empty`` (it holds no row), ``partial`` (damaged after its first rows, which
    are kept) or ``failed``. It is kept at ``out``/ledger. Rows are counted on what was stored, so files are scanned once.

    Rows without ``source_file`` or ``row_ord`` get their file and their position in it, whatever the other files have.
    """
    files = write_stage(
        list_files(spark, path, pattern).repartition("source_file").mapInPandas(_footers, _FOOTER_SCHEMA), "footers"
    )
    schema = StructType([StructField(name, kind) for name, kind in {**CHARGE_COLUMNS, **CHARGE_EXTRAS}.items()])
    raw = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(*([path] if isinstance(path, str) else path))
    )
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = raw.select(
        *[c for c in schema.names if c not in ("source_file", "row_ord", "row_chunk")],
        F.coalesce("source_file", file).alias("source_file"),
        F.coalesce("row_ord", at).alias("row_ord"),
        F.coalesce("row_chunk", row_chunk(F.coalesce("row_ord", at))).alias("row_chunk"),
        file.alias("charge_file"),
    )
    write_charges(rows, f"{out}/charges")
    loaded = spark.read.parquet(f"{out}/charges").groupBy("charge_file").agg(F.count("*").alias("rows_loaded"))
    ledger = (
        files.withColumnRenamed("source_file", "charge_file")
        .join(loaded, "charge_file", "left")
        .withColumn("rows_loaded", F.coalesce("rows_loaded", F.lit(0)))
        .withColumn(
            "outcome",
            F.when(F.col("rows_written") == 0, "empty")
            .when(F.col("rows_loaded") == F.col("rows_written"), "loaded")
            .when(F.col("rows_loaded") > 0, "partial")
            .otherwise("failed"),
        )
    )
    ledger.write.mode("overwrite").parquet(f"{out}/ledger")
    return spark.read.parquet(f"{out}/ledger")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Files, rows and bytes of each outcome."""
    return ledger.groupBy("outcome").agg(
        F.count("*").alias("files"), F.sum("rows_loaded").alias("rows_loaded"), F.sum("bytes").alias("bytes")
    )
