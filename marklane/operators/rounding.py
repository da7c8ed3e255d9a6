"""Rounding doubles on their exact binary value, in column functions.

A double is a whole number times a power of two. Times 10 ** digits it is a fraction of two whole numbers that decimals of 38 digits
hold exactly, so its quotient and remainder tell the nearest whole number, halves to even; dividing that by 10 ** digits, both
exact as doubles, gives the double nearest to the rounded decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places that can be asked for.
MOST_DIGITS = 15


def exact_round(x: Column, digits: int) -> Column:
    """``x`` (a double) rounded to 0 to 15 decimal places. Null, NaN and infinities stay; the sign of zero is kept."""
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"0 to {MOST_DIGITS} digits")
    x = x.cast("double")
    size, tens = F.abs(x), 10**digits
    # 2 ** up times the number is whole; one more than needed, as the logarithm may be off by one
    up = F.greatest(F.lit(0), F.lit(53) - F.floor(F.log2(F.when(size > 0, size))).cast("int"))
    whole = (size * F.pow(F.lit(2.0), up.cast("double"))).cast("long").cast("decimal(19,0)")
    two = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).cast("decimal(19,0)")
    below = (two(F.least(up, F.lit(62))) * two(F.greatest(F.lit(0), up - 62))).cast("decimal(38,0)")
    above = (whole * F.lit(tens).cast("decimal(16,0)")).cast("decimal(38,0)")
    quotient, rest = F.call_function("div", above, below), above % below
    odd = quotient % 2 == 1
    nearest = quotient + F.when((rest * 2 > below) | ((rest * 2 == below) & odd), 1).otherwise(0)
    rounded = nearest.cast("double") / F.lit(float(tens))
    small, large = size < 2.0**-68, size * float(tens) >= 2.0**53
    signed = F.when(F.isnan(x) | large | (x == 0), x).when(small, x * 0.0).otherwise(rounded * F.signum(x))
    return F.when(x.isNotNull(), signed)


def samples(seconds: Column, rate: Column) -> Column:
    """Seconds as a number of samples: rounded to four digits, then up."""
    return F.ceil(exact_round(seconds.cast("double") * rate, 4)).cast("long")
