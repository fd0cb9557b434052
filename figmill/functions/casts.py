"""Lenient casts and number formats. Each dialect of missing values has a function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("1", "true", "yes", "y")
NUMBER = r"^\s*[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?\s*$"


def truthy(c: Column) -> Column:
    """Whether the text is one of 1, true, yes, y in any case; never null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def number_or_null(c: Column) -> Column:
    """The number a text holds: blanks around it and underscores between digits are allowed, suffixes such as 3d not."""
    text = c.cast("string")
    special = F.lower(F.trim(text))
    value = F.when(special.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    value = value.when(special.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(special.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return value.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def number_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(number_or_null(c), F.lit(default))


def number_unless_blank(c: Column) -> Column:
    """As number_or_null; the word null in any case is missing too."""
    return F.when(~F.lower(F.trim(c.cast("string"))).isin("", "null", "none"), number_or_null(c))


def bounded(c: Column, low: float, high: float) -> Column:
    """Clamped; null, NaN and infinities give 0."""
    odd = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, F.lit(0.0)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clamped_high_nan(c: Column, low: float, high: float) -> Column:
    """Clamped where NaN counts as highest; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def yes_no(c: Column, default: str = "no") -> Column:
    word = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(word.isin("yes", "y", "true", "1"), "yes").when(word.isin("no", "n", "false", "0"), "no").otherwise(default)


def general_format(c: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g."""
    parts = F.split(F.format_string("%.5e", c), "e")
    power = F.get(parts, F.lit(1)).try_cast("int")  # null for null, NaN and infinities
    digits = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(0)), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.regexp_replace(F.format_string("%.5e", c).try_cast("double").try_cast("decimal(24,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    exponent = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    odd = F.when(c.isNull(), None).when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return odd.when(c == 0, "0").when((power < -4) | (power >= 6), exponent).otherwise(plain)


def score_label(c: Column) -> Column:
    """9.0 as 9, 9.50 as 9.5: up to three decimals, trailing zeros dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", c), "0+$", ""), r"\.$", "")
