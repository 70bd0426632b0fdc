"""Decimal rounding that looks at the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, cuts a double into two 26-bit halves


def round_exact(col: Column, digits: int) -> Column:
    """Round a non-negative double to ``digits`` places, exact ties to even.

    The built-in ``round`` works on the shortest decimal text of a double and
    ``rint(x * 10**n)`` on a rounded product; both can cross a half. Here the
    product's rounding error is recovered and decides the near-ties.
    """
    scale = float(10 ** digits)

    def settle(x: Column) -> Column:
        product = x * scale
        high = x * _SPLITTER - (x * _SPLITTER - x)
        error = (high * scale - product) + (x - high) * scale
        floor = F.floor(product).cast("double")
        rest = product - floor
        up = (rest > 0.5) | ((rest == 0.5) & (
            (error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2.0)) == 1.0))))
        return (floor + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.transform(F.array(col), settle)[0]
