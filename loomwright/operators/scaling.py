"""Scaling with learned numbers, one for each place of the innermost arrays (or one, for scalars)."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.nested import map_inner
from loomwright.stage import REQUIRED, Operator, no_nulls, number
from loomwright.types import FLOATS, T, depth


class _Scaled(Operator):
    ACCEPTS = FLOATS
    PARAMS: ClassVar[dict] = {"maskValue": None}
    CHECKS: ClassVar[dict] = {"maskValue": number}

    def numbers(self) -> tuple[list[float], list[float]]:
        """What is taken from each place, and what the rest is multiplied by."""
        raise NotImplementedError

    def scaled(self, x: Column, shift: Column, factor: Column) -> Column:
        out = (x - shift) * factor
        mask = self.p("maskValue") if "maskValue" in self.ALL else None
        return out if mask is None else F.when(x == F.lit(mask), x).otherwise(out)

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        shifts, factors = self.numbers()
        if not depth(kinds[0]):
            if len(shifts) != 1:
                raise ValueError(f"{len(shifts)} numbers were learned, for arrays of that length, but the column holds scalars")
            return self.scaled(cols[0], F.lit(shifts[0]), F.lit(factors[0]))
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(shifts, factors, strict=True)])
        return map_inner(cols, kinds, lambda x: F.zip_with(x, pairs, lambda y, p: self.scaled(y, p["a"], p["b"])))


class StandardScaleTransformer(_Scaled):
    """Less the mean, divided by the deviation (times 0, where that is 0); maskValue stays."""

    PARAMS: ClassVar[dict] = {"mean": REQUIRED, "stddev": REQUIRED}
    CHECKS: ClassVar[dict] = {"mean": no_nulls, "stddev": no_nulls}

    def numbers(self) -> tuple[list[float], list[float]]:
        return self.p("mean"), [1.0 / s if s else 0.0 for s in self.p("stddev")]


class ConditionalStandardScaleTransformer(StandardScaleTransformer):
    """As StandardScale; with skipZeros what is within epsilon of 0 becomes 0."""

    PARAMS: ClassVar[dict] = {"skipZeros": False, "epsilon": 0.0}
    CHECKS: ClassVar[dict] = {"epsilon": number}

    def scaled(self, x: Column, shift: Column, factor: Column) -> Column:
        out = (x - shift) * factor
        return F.when(F.abs(x) <= F.lit(self.p("epsilon")), F.lit(0.0)).otherwise(out) if self.p("skipZeros") else out


class MinMaxScaleTransformer(_Scaled):
    """Less the least, divided by the range (times 0, where that is 0); maskValue stays."""

    PARAMS: ClassVar[dict] = {"min": REQUIRED, "max": REQUIRED}
    CHECKS: ClassVar[dict] = {"min": no_nulls, "max": no_nulls}

    def numbers(self) -> tuple[list[float], list[float]]:
        low, high = self.p("min"), self.p("max")
        return low, [1.0 / (b - a) if b != a else 0.0 for a, b in zip(low, high, strict=True)]
