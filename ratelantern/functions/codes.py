"""Billing codes: pivot to one column per code type and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelantern.fixed_values import CODE_COLUMNS, CODE_TYPE_EXPLANATIONS
from ratelantern.functions.clean import trimmed


def code_columns(pairs: Column) -> list[Column]:
    """One column per code type from an ``array<struct<code, type>>``; the last pair wins.

    ``pairs`` must already carry upper-case types.
    """
    def last_code(code_type: str) -> Column:
        of_type = F.filter(pairs, lambda p: p["type"] == code_type)
        return F.get(of_type, F.size(of_type) - 1)["code"]

    return [last_code(code_type).alias(column) for code_type, column in CODE_COLUMNS.items()]


def has_code() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in CODE_COLUMNS.values()]).isNotNull()


def code_text() -> Column:
    """All filled codes of a charge row as ``TYPE:code|TYPE:code``, in the fixed order."""
    return F.concat_ws(
        "|",
        *[
            F.when(F.col(column) != "", F.concat(F.lit(f"{code_type}:"), F.col(column)))
            for code_type, column in CODE_COLUMNS.items()
        ],
    )


def unpivot_codes(df: DataFrame, *keep: str) -> DataFrame:
    """One row per filled code column, in the fixed order of code types."""
    every = F.array(
        *[
            F.struct(F.col(column).alias("code"), F.lit(code_type).alias("code_type"))
            for code_type, column in CODE_COLUMNS.items()
        ]
    )
    # Unfolding all and filtering after compiles to a plain loop; a lambda would not.
    return df.select(*keep, F.inline(every)).where(F.col("code") != "")


def normalised_key(c: Column) -> Column:
    return F.upper(trimmed(c))


def explain_code_type(code_type: Column) -> Column:
    entries = [F.lit(v) for pair in CODE_TYPE_EXPLANATIONS.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), normalised_key(code_type))
