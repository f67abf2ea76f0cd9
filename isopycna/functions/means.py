"""Means whose last digits don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(x: Column) -> Column:
    """Mean of the values of ``x`` that are there, none of them infinite, whatever order they come in.

    Sums of doubles end in rounding errors that change with the order; where values cancel out, these are all that is left and
    decide the sign.  Here each value is cut into multiples of 2**-20, of 2**-50 and the rest, and doubles add up each kind
    without an error: with up to 2**24 values, sums below 2**33 and no digits beyond 2**-80; past these it is as good as a plain sum.
    """
    high = F.when(F.abs(x) < 2.0**33, F.rint(x * 2.0**20) / 2.0**20).otherwise(x)
    middle = F.rint((x - high) * 2.0**50) / 2.0**50
    return (F.sum(high) + F.sum(middle) + F.sum(x - high - middle)) / F.nullif(F.count(x), F.lit(0))
