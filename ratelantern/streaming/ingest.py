"""Loading of charge files as they arrive.

Each run picks up the Parquet files added since the last one (one file per hospital file, as
the converters write them) and adds them to the star. A batch is written to a folder of its
own number and overwrites it when repeated, so a batch that fails halfway and runs again
leaves no duplicates.

Keys of shared dimensions are stored in buckets by the first characters of their id, which is a hash. A batch
compares its keys with earlier ones of the buckets it touches; the other folders are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ratelantern.operators.charges import as_charges
from ratelantern.operators.ordered import row_chunk
from ratelantern.operators.star import STAR_TABLES, build_star, with_ids
from ratelantern.schemas import CHARGE_COLUMNS, CHARGE_EXTRAS
from ratelantern.session import write_stage

# Dimensions shared by all files: only keys not loaded yet are added. The first column is the key.
SHARED = {
    "codes": "code_id string, code string, code_type string",
    "payers": "payer_id string, name string",
    "plans": "plan_id string, name string",
}
# Characters of a key that name its bucket: 16 ^ 2 buckets. The same for all batches of a dimension.
BUCKET_CHARACTERS = 2
_PROVENANCE = ("source_file", "row_ord", "row_chunk")


def read_star(spark: SparkSession, star_path: str) -> dict[str, DataFrame]:
    """The tables of a star loaded by ``load_new_files``."""
    return {
        name: read_dimension(spark, star_path, name).drop("batch", "bucket")
        if name in SHARED
        else spark.read.parquet(f"{star_path}/{name}").drop("batch")
        for name in STAR_TABLES
    }


def read_dimension(spark: SparkSession, star_path: str, name: str) -> DataFrame:
    """A shared dimension with its batch and bucket; they are folders, so filters on them prune."""
    return spark.read.schema(f"{SHARED[name]}, batch int, bucket string").parquet(f"{star_path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _bucket(key: str, characters: int) -> Column:
    # With a letter in front, no folder name looks like a number.
    return F.concat(F.lit("b"), F.substring(key, 1, characters))


def earlier_keys(
    spark: SparkSession, star_path: str, name: str, batch: int, incoming: DataFrame, characters: int = BUCKET_CHARACTERS
) -> DataFrame | None:
    """Keys of earlier batches in the buckets of ``incoming`` (None: nothing is loaded yet)."""
    if not _exists(spark, f"{star_path}/{name}"):
        return None
    key = incoming.columns[0]
    # No more than there are buckets.
    touched = [r.bucket for r in incoming.select(_bucket(key, characters).alias("bucket")).distinct().collect()]
    known = read_dimension(spark, star_path, name)
    return known.where(F.col("bucket").isin(touched) & (F.col("batch") < batch)).select(key)


def add_to_dimension(
    spark: SparkSession, star_path: str, name: str, batch: int, incoming: DataFrame, characters: int = BUCKET_CHARACTERS
) -> None:
    """Add the keys of a batch that no earlier one had; a repeated batch replaces what it wrote."""
    key = incoming.columns[0]
    earlier = earlier_keys(spark, star_path, name, batch, incoming, characters)
    new = incoming if earlier is None else incoming.join(earlier, key, "left_anti")
    (
        new.withColumn("bucket", _bucket(key, characters))
        .repartition("bucket")
        .sortWithinPartitions("bucket", key)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{star_path}/{name}/batch={batch}")
    )


def load_new_files(
    spark: SparkSession,
    input_path: str,
    star_path: str,
    checkpoint: str,
    *,
    files_per_batch: int = 1000,
    skip_payer_charges: bool = False,
) -> StreamingQuery:
    """Start a run over all files not loaded so far; it ends by itself."""
    columns = {k: t for k, t in {**CHARGE_COLUMNS, **CHARGE_EXTRAS}.items() if k not in _PROVENANCE}
    at = F.col("_metadata.row_index")
    files = (
        spark.readStream.schema(StructType([StructField(k, t) for k, t in columns.items()]))
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(input_path)
        .select(
            *columns,
            F.col("_metadata.file_path").alias("source_file"),
            at.alias("row_ord"),
            row_chunk(at).alias("row_chunk"),
        )
    )

    def load(batch: DataFrame, number: int) -> None:
        rows = write_stage(with_ids(as_charges(batch)), f"batch-{number}")
        for name, table in build_star(rows, skip_payer_charges=skip_payer_charges).items():
            if name in SHARED:
                incoming = write_stage(table, f"batch-{number}-{name}")
                add_to_dimension(batch.sparkSession, star_path, name, number, incoming)
            else:
                table.write.mode("overwrite").parquet(f"{star_path}/{name}/batch={number}")

    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
