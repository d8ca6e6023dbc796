"""Number helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def rounded(value: Column, digits: int = SCORE_DIGITS) -> Column:
    """Round so that ranks do not depend on the order in which a shuffle adds floats."""
    return F.round(value, digits) + F.lit(0.0)


def fixed(value: Column, digits: int) -> Column:
    """Text with `digits` decimals, rounded half-even on the exact binary value."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
