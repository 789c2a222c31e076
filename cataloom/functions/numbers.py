"""Number expressions: prices, ratings, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits with optional thousands groups, and a fraction of one or two digits.
PRICE = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?"


def round1(x: Column) -> Column:
    """Half-up to one decimal: floor(10 x + 0.5) / 10, the same in every engine."""
    return F.floor(x * 10 + 0.5) / 10


def discount_percent(original: Column, current: Column) -> Column:
    """Percent off to one decimal; null unless the original price is positive and higher."""
    return F.when((original > 0) & (original > current), F.floor((original - current) / original * 1000.0 + 0.5) / 10)


def price_values(text: Column) -> Column:
    """All prices of a text in order; numbers that are none are null.

    Bengali digits count as digits. A whole part of several digits must not start with 0, and with a fraction it must be
    10 or more.
    """
    plain = F.translate(text, "০১২৩৪৫৬৭৮৯", "0123456789")
    found = F.regexp_extract_all(plain, F.lit(PRICE), F.lit(0))

    def value(match: Column) -> Column:
        whole = F.replace(F.substring_index(match, ".", 1), F.lit(","), F.lit(""))
        fraction = F.contains(match, F.lit("."))
        bad = (F.length(whole) > 1) & whole.startswith("0") | fraction & (F.try_to_number(whole, F.lit("9" * 30)) < 10)
        return F.when(~F.coalesce(bad, F.lit(False)), F.replace(match, F.lit(","), F.lit("")).try_cast("double"))

    return F.transform(found, value)


def first_price(text: Column) -> Column:
    """The first price from 5 to under 100,000,000."""
    return F.get(F.filter(price_values(text), lambda v: (v >= 5) & (v < 1e8)), F.lit(0))


def largest_price(text: Column) -> Column:
    """The largest price; null if there is none over 0."""
    top = F.array_max(price_values(text))
    return F.when(top > 0, top)


def csv_price(cell: Column) -> Column:
    """An inventory cell's digits and points as a number; null if they are none."""
    return F.regexp_replace(cell, "[^0-9.]", "").try_cast("double")


def rating(text: Column) -> Column:
    """The first number as stars of five, one decimal: up to 5 as it is, up to 100 divided by 20, else null."""
    v = F.replace(F.regexp_extract(text, r"(\d+[.,]?\d*)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((v > 5) & (v <= 100), round1(v / 20.0)).when((v >= 0) & (v <= 5), round1(v))


def price_confidence(price: Column, low: Column, high: Column) -> Column:
    """From 0.4 to 1 by closeness to the geometric middle of the range; 0 outside it or without a price."""
    middle = F.sqrt(low * F.least(high, low * 1000))
    near = F.greatest(F.lit(0.4), 1 - F.abs(F.ln(price) - F.ln(middle)) / 5.0)
    return F.when(F.coalesce(price.between(low, high), F.lit(False)), near).otherwise(0.0)


def index_percentile_rank(n: int, q: float) -> int:
    """0-based place of a percentile among n sorted values: the middle one for a half, else rounded half up and clamped."""
    return min(n - 1, n // 2 if q == 0.5 else math.floor(n * q + 0.5))
