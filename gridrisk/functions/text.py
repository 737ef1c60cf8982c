"""Text, key and number normalisation as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def norm_text(value: Column) -> Column:
    """Lower-case words of letters and digits separated by single blanks; null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def _digits(value: Column, width: int) -> Column:
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9]", "")
    some = F.nullif(F.substring(digits, 1, width), F.lit(""))
    return F.coalesce(F.lpad(some, width, "0"), F.lit(""))


def norm_zip(value: Column) -> Column:
    return _digits(value, 5)


def norm_fips(value: Column) -> Column:
    return _digits(value, 5)


def norm_zip4(value: Column) -> Column:
    return _digits(value, 4)


def norm_state(value: Column) -> Column:
    return F.trim(F.upper(F.coalesce(value, F.lit(""))))


def pad_geo_id(value: Column) -> Column:
    """Left-pad to five characters; longer ids are kept whole."""
    return F.when(F.length(value) < 5, F.lpad(value, 5, "0")).otherwise(value)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?inf(inity)?$"


def to_number(value: Column) -> Column:
    """Double of a text, or null for anything that is not a number (including 'nan' and '12d')."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def numeric(df: DataFrame, column: str) -> Column:
    """A double column whatever the landed type: text is parsed, NaN becomes null."""
    kind = df.schema[column].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    return to_number(F.col(column))


def address_key(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return F.concat_ws("|", norm_text(address), norm_text(city), norm_state(state), norm_zip(zip_code))


def geo_join_key(state: Column, zip_code: Column, zip4: Column) -> Column:
    return F.concat_ws("|", norm_state(state), norm_zip(zip_code), norm_zip4(zip4))


def date_prefix(value: Column) -> Column:
    """The date part of an ISO timestamp text; empty becomes null."""
    return F.substring(F.nullif(value, F.lit("")), 1, 10)


def title_case(value: Column) -> Column:
    """Title case that also starts a new word after any non-letter, so ``sma_x`` → ``Sma_X``."""
    words = F.regexp_extract_all(F.lower(value), F.lit("([^\\p{L}]*\\p{L}*)"), F.lit(1))
    capital = F.transform(
        words,
        lambda w: F.concat(
            F.regexp_extract(w, "^([^\\p{L}]*)", 1),
            F.initcap(F.regexp_extract(w, "(\\p{L}*)$", 1)),
        ),
    )
    return F.array_join(capital, "")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when the text contains any of the terms; the terms have to be lower case already."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def whole_word_pattern(terms: Iterable[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")\b"


def is_relevant_text(text: Column, terms: Iterable[str]) -> Column:
    """True when any term occurs as a whole word, ignoring case; null text is not relevant."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(whole_word_pattern(terms))


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
