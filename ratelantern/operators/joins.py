"""Joins that hold when one key carries a large share of the rows."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
HOT_ROWS = 5_000_000
MAX_HOT_KEYS = 2_000


def tasks_for(n_rows: int, rows_per_task: int) -> int:
    """How many tasks take ``n_rows``, so that the memory of one does not grow with the input."""
    return max(1, math.ceil(n_rows / rows_per_task))


def _salt_of(columns: Sequence[str], salts: int):
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def _every_salt(salts: int):
    return F.sequence(F.lit(0), F.lit(salts - 1))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """Join whose left side may have hot keys.

    Keys with more than ``hot_rows`` rows on the left are found by a count over the key
    columns. Their left rows are dealt to ``salts`` sub-keys by a hash of ``spread`` (columns
    that differ between rows), their right rows are repeated per sub-key; all other rows join
    as usual. The list of hot keys is a hint for placement only and is limited to the
    ``MAX_HOT_KEYS`` largest, so broadcasting it is safe and results never depend on it.
    ``tasks`` says how many tasks share the left rows; otherwise the session's settings do.

    Neither side is broadcast: without hot keys the optimizer takes a side joined to their empty list for empty, however large.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot repeat its right side")
    on = list(on)
    hot = F.broadcast(
        left.groupBy(*on)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"), *on)
        .limit(MAX_HOT_KEYS)
        .select(*on, F.lit(True).alias("_hot"))
    )
    dealt = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), _salt_of(spread, salts)).otherwise(0))
        .drop("_hot")
    )
    repeated = (
        right.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), _every_salt(salts)).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    if tasks is not None:
        dealt = dealt.repartition(tasks, *on, "_salt")
    return dealt.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    lookup_bytes: int,
    spread: Sequence[str],
    limit: int = BROADCAST_BYTES,
    salts: int = 64,
) -> DataFrame:
    """Attach a lookup of known size: broadcast while small, else repeat it per salt.

    The second way shuffles ``rows`` on key and salt, so a key that owns a third of the rows
    is still spread over ``salts`` tasks.
    """
    on = list(on)
    if lookup_bytes <= limit:
        return rows.join(F.broadcast(lookup), on)
    dealt = rows.withColumn("_salt", _salt_of(spread, salts))
    repeated = lookup.withColumn("_salt", F.explode(_every_salt(salts)))
    return dealt.join(repeated, [*on, "_salt"]).drop("_salt")
