"""Order-dependent operators that never sort one whole file in one task.

Rows are cut into chunks of bounded size along the order. Each chunk is handled on its own;
a table with one row per chunk carries what the next chunk needs to know. So a file that
holds a third of all rows is spread over as many tasks as it has chunks.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20


def row_chunk(row_ord: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(row_ord / rows)


def mark_runs(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str],
    chunk: Column,
    out: str = "run",
) -> DataFrame:
    """Number the runs of adjacent rows with equal keys, from 1, within ``by``.

    ``chunk`` must grow with the order and be a function of the first order column.
    """
    return mark_nested_runs(df, by, order, {out: keys}, chunk)


def mark_nested_runs(
    df: DataFrame, by: Sequence[str], order: Sequence[str], levels: Mapping[str, Sequence[str]], chunk: Column
) -> DataFrame:
    """Number the runs of several levels (output column to keys) in one pass.

    One sort numbers all levels inside the chunks, and one row per chunk carries the first and last keys
    and the number of runs of every level on to the next.
    """
    by = list(by)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("_chunk")
    here = {out: F.struct(*keys) for out, keys in levels.items()}

    numbered = df.withColumn("_chunk", chunk).withColumns(
        {"_n": F.row_number().over(inside), **{f"_before_{out}": F.lag(h).over(inside) for out, h in here.items()}}
    )
    numbered = numbered.withColumns(
        {
            f"_new_{out}": ((F.col("_n") > 1) & ~h.eqNullSafe(F.col(f"_before_{out}"))).cast("bigint")
            for out, h in here.items()
        }
    ).withColumns({f"_inner_{out}": F.sum(f"_new_{out}").over(inside) for out in levels})
    summaries = []
    for out, h in here.items():
        summaries += [
            F.min_by(h, F.col("_n")).alias(f"_first_{out}"),
            F.max_by(h, F.col("_n")).alias(f"_last_{out}"),
            F.sum(f"_new_{out}").alias(f"_news_{out}"),
        ]
    edges = numbered.groupBy(*by, "_chunk").agg(*summaries)
    opens = {
        out: F.when(
            (F.row_number().over(across) > 1)
            & F.col(f"_first_{out}").eqNullSafe(F.lag(f"_last_{out}").over(across)),
            0,
        ).otherwise(1)
        for out in levels
    }
    edges = edges.withColumns({f"_opens_{out}": o for out, o in opens.items()})
    bases = edges.select(
        *by,
        "_chunk",
        *[
            (F.sum(F.col(f"_opens_{out}") + F.col(f"_news_{out}")).over(across) - F.col(f"_news_{out}")).alias(f"_base_{out}")
            for out in levels
        ],
    )
    runs = {out: F.col(f"_base_{out}") + F.col(f"_inner_{out}") for out in levels}
    helpers = [f"_{kind}_{out}" for kind in ("before", "new", "inner", "base") for out in levels]
    return numbered.join(bases, [*by, "_chunk"]).withColumns(runs).drop("_chunk", "_n", *helpers)


def running_offset(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    chunk: Column,
    out: str = "offset",
) -> DataFrame:
    """Sum of ``value`` over all earlier rows within ``by``."""
    by = list(by)
    inside = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*by)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    chunked = df.withColumn("_chunk", chunk)
    sums = chunked.groupBy(*by, "_chunk").agg(F.sum(value).alias("_sum"))
    bases = sums.select(*by, "_chunk", (F.sum("_sum").over(across) - F.col("_sum")).alias("_base"))
    return (
        chunked.withColumn("_inner", F.sum(value).over(inside) - F.col(value))
        .join(bases, [*by, "_chunk"])
        .withColumn(out, F.col("_base") + F.col("_inner"))
        .drop("_chunk", "_inner", "_base")
    )
