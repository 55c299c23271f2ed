"""Means of doubles that don't depend on the order in which rows are added.

A number is cut into parts of a few bits on a fixed grid. The parts are whole numbers, of which sums are
exact, so neither the partitions nor the order of their results show in the mean.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a part, and parts of a number. Sums of parts have 64 bits, enough for 2**37 rows.
BITS, PARTS = 26, 4
#: Numbers below 2**USUAL are cut without a look at the greatest one first.
USUAL = 40


def exponent_of(most: float) -> int:
    """The exponent of the grid for numbers up to ``most``, which is finite: the usual one, if that keeps their digits."""
    if most == 0 or 2.0 ** (USUAL + 53 - BITS * PARTS) <= most < 2.0**USUAL:
        return USUAL
    return max(math.frexp(most)[1], BITS * PARTS - 1074)  # of that grid, the least double is a step


def sums_of_parts(x: Column, exponent: int = USUAL) -> list[Column]:
    """Aggregates for ``mean_of``, over the numbers below 2**exponent (1000 at most); NULL where a sum has more than 64 bits."""
    x = F.when(F.abs(x) < F.lit(2.0**exponent), x.cast("double"))
    cut = [F.rint(x * F.lit(2.0 ** (BITS * k - exponent))) for k in range(1, PARTS + 1)]
    parts = [cut[0], *[low - high * F.lit(2.0**BITS) for high, low in zip(cut, cut[1:], strict=False)]]
    return [F.try_sum(p.cast("bigint")) for p in parts]


def mean_of(sums: list[int], n: int, exponent: int = USUAL) -> float:
    """The mean of n numbers, from the sums of their parts."""
    total = sum(s << BITS * (PARTS - 1 - k) for k, s in enumerate(sums))
    return float(total * Fraction(2) ** (exponent - BITS * PARTS) / n)
