"""Session defaults and the shared folder for intermediate tables."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The JVM never compiles longer methods; Spark's own limit lets generated code of wide rows run interpreted.
METHOD_LIMIT, JIT_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

#: Whether files of a shuffle go when the job that made them has ended, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "ratelantern", **settings: str) -> SparkSession:
    """A session with the settings the jobs here are tuned for.

    Shuffle partitions start high and adaptive execution merges the small ones, so one
    setting serves both a laptop and a large cluster. Python workers of a local session find this
    package even if only ``sys.path`` names it here; on a cluster it has to be installed.
    """
    root = str(Path(__file__).resolve().parents[1])
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Hash instead of sort where a partition of the smaller side fits in memory.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config(METHOD_LIMIT, JIT_BYTES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ratelantern-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves its output on disk and no shuffle files: a frame written is read back, not run again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def write_stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later steps then start from columnar files: lineage is cut, a lost executor costs no
    recomputation of earlier steps, and each reader prunes to the columns it needs. ``folders`` are columns, the last
    ones, that rows are laid into folders by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    limit = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, JIT_BYTES)  # the session may not be one of build_session
    try:
        with shuffles_freed(spark):
            # Hash ids are much of a stage; this codec makes them half as long, the default leaves them.
            df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    finally:
        spark.conf.set(METHOD_LIMIT, limit)
    return spark.read.schema(df.schema).parquet(path)
