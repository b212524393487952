"""Column expressions for prices; decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"
# The patterns of prices below are fixed values: results must be exactly theirs.


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast(MONEY)


def comma_price(text: Column) -> Column:
    """1.234,56: the first number with a comma and two digits; dots and spaces, hard ones too, part thousands."""
    pattern = r"(?U)(\d+(?:[.\s]\d{3})*),(\d{2})"
    whole = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(?U)[.\s]", "")
    return F.when(text.rlike(pattern), _number(F.concat(whole, F.lit("."), F.regexp_extract(text, pattern, 2))))


def dot_price(text: Column, given: Column | None = None) -> Column:
    """1234.56, or a given attribute's number where that is one."""
    found = _number(F.regexp_extract(text, r"\b(\d+\.\d{2})\b", 1))
    return found if given is None else F.coalesce(given.try_cast(MONEY), found)


def lei_price(text: Column) -> Column:
    """1.234 lei: whole numbers with dots between thousands."""
    return _number(F.replace(F.regexp_extract(text, r"(?iU)(\d{1,3}(?:\.\d{3})*)\s*lei", 1), F.lit("."), F.lit("")))


def discount_percent(price: Column, old: Column) -> Column:
    """Whole percent, halves to even; null without an old price above the price."""
    share = (old - price).cast("decimal(12,2)") * 100 / old
    return F.when((old > 0) & (price < old), F.bround(share.cast("decimal(20,8)"), 0).cast("int"))


def entered_price(text: Column) -> Column:
    """A typed price, comma or dot; null unless it is a number above 0."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast(MONEY)
    return F.when(value > 0, value)


def entered_volume(text: Column) -> Column:
    value = F.trim(text).try_cast("int")
    return F.when(value > 0, value)


def price_per_ml(price: Column, volume: Column) -> Column:
    return F.when(price.isNotNull() & (volume > 0), (price / volume.cast("decimal(6,0)")).cast("decimal(18,6)"))
