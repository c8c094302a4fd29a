"""Rounding and formatting that agree with half-to-even arithmetic on doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round a double half to even at ``digits`` decimals, as numpy does."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def fixed(value: Column, digits: int) -> Column:
    """Text of a double with ``digits`` decimals, half to even."""
    return F.format_string(f"%.{digits}f", round_even(value.cast("double"), digits))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exact_mean(value: Column, digits: int = 3) -> Column:
    """Mean of measured values carrying at most ``digits`` decimals.

    The sum is taken in decimals, so the result does not depend on the number or
    order of partitions.
    """
    total = F.sum(value.cast(f"decimal(18,{digits})"))
    return ratio(total, F.count(value))
