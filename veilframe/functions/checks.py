"""Small value checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_valid(value: Column) -> Column:
    """True for 13 to 19 digits (other characters ignored) with a valid check digit."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
