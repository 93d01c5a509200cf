"""Cleaning of text columns.

Casts go through ``try_cast``: with ANSI mode on a plain cast of dirty text fails the job, while
cleaning must give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets that survive cleaning, sentinel texts, list and default texts.
NOT_LETTER_OR_SPACE = "[^A-Za-z ]"
WHITESPACE = r"\s+"
NOT_DIGIT = "[^0-9]"
NOT_UNSIGNED_NUMBER = "[^0-9.]"
NOT_SIGNED_NUMBER = r"[^0-9.\-]"
YEARS = r"(\d+)\s+Years?"
MONTHS = r"(\d+)\s+Months?"
OCCUPATION_SENTINEL = "_______"
BEHAVIOUR_SENTINEL = "!@9#%8"
EMPTY_SENTINEL = "_"
UNKNOWN = "Unknown"
NOT_SPECIFIED = "not specified"
CONJUNCTION = "and "


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Whole number, truncated toward zero. Through double, since '12.0' is not an int text."""
    return c.try_cast("double").try_cast("int")


def letters_and_spaces(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), NOT_LETTER_OR_SPACE, "")


def without_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, WHITESPACE, "")


def digits(c: Column) -> Column:
    """Digits only; a leading minus is lost, so '-500' becomes '500'."""
    return F.regexp_replace(c, NOT_DIGIT, "")


def clean_number(c: Column, signed: bool = False) -> Column:
    return to_double(
        F.regexp_replace(c, NOT_SIGNED_NUMBER if signed else NOT_UNSIGNED_NUMBER, "")
    )


def replace_value(c: Column, sentinel: str, value: str) -> Column:
    return F.when(c == sentinel, F.lit(value)).otherwise(c)


def null_if(c: Column, sentinel: str) -> Column:
    return F.nullif(c, F.lit(sentinel))


def default_text(c: Column, value: str = NOT_SPECIFIED) -> Column:
    return F.coalesce(c, F.lit(value))


def without_conjunction(c: Column) -> Column:
    """Drop every 'and ' (also inside words), then trim and lower."""
    return F.lower(F.trim(F.regexp_replace(c, CONJUNCTION, "")))


def duration_part(c: Column, pattern: str) -> Column:
    """The number that ``pattern`` captures, 0 when it is absent."""
    return F.coalesce(to_double(F.regexp_extract(c, pattern, 1)), F.lit(0.0))


def duration_months(c: Column) -> Column:
    return duration_part(c, YEARS) * F.lit(12.0) + duration_part(c, MONTHS)


def code_part(c: Column, position: int, separator: str = "_", keep: str = UNKNOWN) -> Column:
    """One part of a compound code, NULL if there are too few parts; the text ``keep`` stays."""
    return F.when(c == keep, F.lit(keep)).otherwise(F.get(F.split(c, separator), F.lit(position)))


def yes_no(c: Column) -> Column:
    """True for any spelling of yes, false for everything else and for NULL."""
    return F.coalesce(F.lower(c) == "yes", F.lit(False))


def split_list(c: Column, separator: str = ",") -> Column:
    return F.split(c, separator)


def normalized_items(items: Column) -> Column:
    """Trimmed lower-case items without NULL and empty ones."""
    tidy = F.transform(items, lambda item: F.lower(F.trim(item)))
    return F.filter(tidy, lambda item: item.isNotNull() & (item != ""))


def without_placeholder(items: Column, placeholder: str = NOT_SPECIFIED) -> Column:
    """Drop the placeholder, unless nothing else is listed: then the list is [placeholder]."""
    listed = F.filter(items, lambda item: item != placeholder)
    return F.when(F.size(listed) == 0, F.array(F.lit(placeholder))).otherwise(listed)


def item_list(c: Column, separator: str = ",", placeholder: str = NOT_SPECIFIED) -> Column:
    return without_placeholder(normalized_items(split_list(c, separator)), placeholder)
