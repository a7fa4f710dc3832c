"""Cleaning of raw text, numbers and dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelantern.fixed_values import NUMBER_PATTERN, WHITE_SPACE


def trimmed(c: Column) -> Column:
    """Strip every kind of Unicode white space (``trim`` alone strips only U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_or_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(cleaned: Column) -> Column:
    value = cleaned.try_cast("double")
    in_range = F.abs(value) < F.lit(float("inf"))
    return F.when(cleaned.rlike(NUMBER_PATTERN) & in_range, value)


def money(c: Column) -> Column:
    """``" $1,234.50 "`` -> 1234.5; anything that is not a finite number -> null."""
    return _number(F.translate(trimmed(c), "$,", ""))


def flexible_number(c: Column) -> Column:
    """A JSON value that may be a number or a text with thousands separators."""
    return _number(F.translate(c, ",", ""))


def is_bad_flexible_number(c: Column) -> Column:
    """True where a non-empty text is no number; strict loads count these."""
    cleaned = F.translate(c, ",", "")
    return F.coalesce((cleaned != "") & flexible_number(c).isNull(), F.lit(False))


def repaired_utf8(c: Column, replacement: str = "\ufffd") -> Column:
    """Invalid bytes -> U+FFFD, one per damaged run; then the wanted replacement."""
    return F.regexp_replace(F.make_valid_utf8(c), "\ufffd+", replacement)


def parsed_date(c: Column) -> Column:
    """ISO date, else month/day/year, else null."""
    return F.coalesce(
        F.try_to_date(c, "yyyy-MM-dd"),
        F.try_to_date(c, "M/d/yyyy"),
    )


def single_value_array(c: Column) -> Column:
    return F.when(c != "", F.array(c))


def joined_modifiers(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, F.array_join(codes, "|", ""))


def split_modifiers(c: Column) -> Column:
    return F.when(c != "", F.split(c, "[|]"))


def first_or_empty(c: Column) -> Column:
    return F.coalesce(F.get(c, 0), F.lit(""))


def payer_amount(negotiated: Column, estimated: Column, median: Column) -> Column:
    return F.coalesce(negotiated, estimated, median)


def display_price(cash: Column, gross: Column) -> Column:
    return F.coalesce(cash, gross)


def display_price_kind(cash: Column, gross: Column) -> Column:
    return F.when(cash.isNotNull(), F.lit("Cash Price")).when(
        gross.isNotNull(), F.lit("Gross Charge")
    )


def as_numeric(c: Column) -> Column:
    """Fixed-point display form; null where the value does not fit."""
    return c.try_cast("decimal(18,4)")


def fixed_text(c: Column, digits: int) -> Column:
    """A number as text with a fixed number of digits, for use inside grouping keys."""
    return F.coalesce(
        c.try_cast(f"decimal(38,{digits})").cast("string"), c.cast("string"), F.lit("")
    )
