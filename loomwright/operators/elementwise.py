"""Arithmetic, logic, conditions and binning, element by element."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.nested import map_leaf
from loomwright.stage import CONDITIONS, REQUIRED, Operator, at_least, number, one_of
from loomwright.types import FLOATS, INTEGERS, NUMBERS, T, element, name_of


class _Elementwise(Operator):
    """One output element from the input elements at its place."""

    #: A parameter that stands for a second input, if set.
    CONSTANT: str | None = None
    MOST: int | None = None
    LEAST = 1

    def leaf(self, *x: Column) -> Column:
        raise NotImplementedError

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        cols, kinds = self.with_constant(cols, kinds)
        if len(cols) < self.LEAST or self.MOST is not None and len(cols) > self.MOST:
            raise ValueError(f"{type(self).__name__}: {len(cols)} inputs, not {self.LEAST} to {self.MOST or 'any number'}")
        return map_leaf(cols, kinds, self.leaf)

    def with_constant(self, cols: list[Column], kinds: list[T.DataType]) -> tuple[list[Column], list[T.DataType]]:
        value = self.p(self.CONSTANT) if self.CONSTANT else None
        if value is None:
            if self.CONSTANT and len(cols) == 1:
                raise ValueError(f"{type(self).__name__}: several inputCols or {self.CONSTANT} must be set")
            return cols, kinds
        if len(cols) > 1:
            raise ValueError(f"{type(self).__name__}: {self.CONSTANT} goes with a single input")
        return [*cols, F.lit(value)], [*kinds, T.DoubleType()]


class AbsoluteValueTransformer(_Elementwise):
    """NULL for the least integer of a type, whose absolute value the type doesn't have."""

    ACCEPTS, MOST = NUMBERS, 1

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        kind = element(kinds[0])
        if kind.simpleString() in FLOATS:
            return map_leaf(cols, kinds, F.abs)
        return map_leaf(cols, kinds, lambda x: F.when(x < 0, F.try_subtract(F.lit(0).cast(kind), x)).otherwise(x))


class ExpTransformer(_Elementwise):
    ACCEPTS, MOST = FLOATS, 1

    def leaf(self, x: Column) -> Column:
        return F.exp(x)


class ExponentTransformer(_Elementwise):
    ACCEPTS, MOST, LEAST, CONSTANT = FLOATS, 2, 2, "exponent"
    PARAMS = {"exponent": None}
    CHECKS = {"exponent": number}

    def leaf(self, x: Column, y: Column) -> Column:
        return F.pow(x, y)


class LogTransformer(_Elementwise):
    """ln(x + alpha); NULL where that is not positive."""

    ACCEPTS, MOST = FLOATS, 1
    PARAMS = {"alpha": 0.0}
    CHECKS = {"alpha": number}

    def leaf(self, x: Column) -> Column:
        return F.log(x + F.lit(self.p("alpha")))


class ModuloTransformer(_Elementwise):
    """The remainder of x by y, plus y where it is negative; NULL for y = 0, and where that sum overflows."""

    ACCEPTS, MOST, LEAST, CONSTANT = NUMBERS, 2, 2, "divisor"
    PARAMS = {"divisor": None}
    CHECKS = {"divisor": number}

    def leaf(self, x: Column, y: Column) -> Column:
        rest = F.try_mod(x, y)
        return F.when(rest >= 0, rest).otherwise(F.try_add(rest, y))


class RoundTransformer(_Elementwise):
    ACCEPTS, MOST = FLOATS, 1
    PARAMS = {"roundType": "round"}
    CHECKS = {"roundType": one_of("round", "floor", "ceil")}

    def leaf(self, x: Column) -> Column:
        return {"round": F.round, "floor": F.floor, "ceil": F.ceil}[self.p("roundType")](x)


class RoundToDecimalTransformer(_Elementwise):
    ACCEPTS, MOST = (*FLOATS, "int", "bigint"), 1
    PARAMS = {"decimals": REQUIRED}
    CHECKS = {"decimals": at_least(0)}

    def leaf(self, x: Column) -> Column:
        return F.round(x, self.p("decimals"))


class _Fold(_Elementwise):
    ACCEPTS, LEAST, CONSTANT = NUMBERS, 2, "mathFloatConstant"
    PARAMS = {"mathFloatConstant": None}
    CHECKS = {"mathFloatConstant": number}

    def leaf(self, *x: Column) -> Column:
        return functools.reduce(self.two, x)

    def two(self, a: Column, b: Column) -> Column:
        raise NotImplementedError


class DivideTransformer(_Fold):
    """From left to right; a quotient by 0 or of a NULL is 0."""

    ACCEPTS = FLOATS

    def two(self, a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))


class MultiplyTransformer(_Fold):
    """From left to right; NULL where an input is NULL or the result overflows."""

    def two(self, a: Column, b: Column) -> Column:
        return F.try_multiply(a, b)


class SubtractTransformer(_Fold):
    def two(self, a: Column, b: Column) -> Column:
        return F.try_subtract(a, b)


class SumTransformer(_Fold):
    def two(self, a: Column, b: Column) -> Column:
        return F.try_add(a, b)


class MaxTransformer(_Fold):
    def leaf(self, *x: Column) -> Column:
        return F.greatest(*x)


class MinTransformer(_Fold):
    def leaf(self, *x: Column) -> Column:
        return F.least(*x)


class MeanTransformer(_Fold):
    def leaf(self, *x: Column) -> Column:
        return functools.reduce(F.try_add, x) / F.lit(float(len(x)))


class _Logical(_Elementwise):
    ACCEPTS, LEAST = ("boolean",), 2


class LogicalAndTransformer(_Logical):
    def leaf(self, *x: Column) -> Column:
        return functools.reduce(lambda a, b: a & b, x)


class LogicalOrTransformer(_Logical):
    def leaf(self, *x: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, x)


class LogicalNotTransformer(_Logical):
    LEAST, MOST = 1, 1

    def leaf(self, x: Column) -> Column:
        return ~x


class _If(_Elementwise):
    """CASE WHEN input (condition) value THEN a ELSE b.

    Of value, a and b each is a constant, if that is set, or else the next of the input columns.
    """

    PARAMS = {"conditionOperator": REQUIRED, "valueToCompare": None, "resultIfTrue": None, "resultIfFalse": None}
    CHECKS = {"conditionOperator": one_of(*CONDITIONS)}

    def with_constant(self, cols: list[Column], kinds: list[T.DataType]) -> tuple[list[Column], list[T.DataType]]:
        left, out, types = list(zip(cols, kinds, strict=True)), [], []
        for constant in (None, "valueToCompare", "resultIfTrue", "resultIfFalse"):
            value = self.p(constant) if constant else None
            if value is None and not left:
                raise ValueError(f"{type(self).__name__}: {constant} or one more input column must be set")
            col, kind = (F.lit(value), _type_of(value)) if value is not None else left.pop(0)
            out.append(col)
            types.append(kind)
        if left:
            raise ValueError(f"{type(self).__name__}: {len(left)} input columns too many")
        # A string next to a number is compared as the number that it spells (NULL if it spells none); as results both are strings.
        for a, b, to in ((0, 1, "double"), (2, 3, "string")):
            text = [isinstance(element(types[i]), T.StringType) for i in (a, b)]
            if text[0] != text[1]:
                i = (a if text[0] else b) if to == "double" else (b if text[0] else a)
                if to == "string" or name_of(types[a if i == b else b]) in NUMBERS:
                    out[i] = map_leaf([out[i]], [types[i]], lambda x, to=to: x.try_cast(to))
        return out, types

    def leaf(self, x: Column, value: Column, yes: Column, no: Column) -> Column:
        return F.when(CONDITIONS[self.p("conditionOperator")](x, value), yes).otherwise(no)


def _type_of(value: Any) -> T.DataType:
    return T.BooleanType() if isinstance(value, bool) else T.StringType() if isinstance(value, str) else T.DoubleType()


class IfStatementTransformer(_If):
    def setParams(self, **kwargs: Any):  # noqa: N802
        super().setParams(**kwargs)
        value = self.p("valueToCompare")
        if self.isDefined("conditionOperator") and self.p("conditionOperator") not in ("eq", "neq") and isinstance(value, str):
            raise ValueError("order comparisons need a number to compare with")
        return self


class NumericalIfStatementTransformer(_If):
    ACCEPTS = FLOATS
    CHECKS = {"valueToCompare": number, "resultIfTrue": number, "resultIfFalse": number}


class BinTransformer(_Elementwise):
    """The label of the first condition that holds, else the default label."""

    ACCEPTS, MOST = NUMBERS, 1
    PARAMS = {"conditionOperators": REQUIRED, "binValues": REQUIRED, "binLabels": REQUIRED, "defaultLabel": REQUIRED}
    CHECKS = {"conditionOperators": lambda names: [one_of(*CONDITIONS)(n) for n in names], "binValues": lambda values: [float(v) for v in values]}

    def leaf(self, x: Column) -> Column:
        names, values, labels = (self.p(k) for k in ("conditionOperators", "binValues", "binLabels"))
        if not len(names) == len(values) == len(labels):
            raise ValueError("conditionOperators, binValues and binLabels must have equal lengths")
        out = F.lit(self.p("defaultLabel"))
        for name, value, label in reversed(list(zip(names, values, labels, strict=True))):
            out = F.when(CONDITIONS[name](x, F.lit(value)), F.lit(label)).otherwise(out)
        return out


class BucketizeTransformer(_Elementwise):
    """1 plus the number of splits up to x; NULL stays NULL, and 0 is left for padding."""

    ACCEPTS, MOST = ("int", "bigint", *FLOATS), 1
    PARAMS = {"splits": REQUIRED}

    @staticmethod
    def _sorted(splits: list[float]) -> list[float]:
        if list(splits) != sorted(splits):
            raise ValueError("splits must be sorted")
        return [float(s) for s in splits]

    CHECKS = {"splits": lambda splits: BucketizeTransformer._sorted(splits)}

    def leaf(self, x: Column) -> Column:
        above = sum((F.when(x >= F.lit(s), 1).otherwise(0) for s in self.p("splits")), F.lit(1))
        return F.when(x.isNotNull(), above.cast("int"))


class IdentityTransformer(_Elementwise):
    MOST = 1

    def leaf(self, x: Column) -> Column:
        return x


class ImputeTransformer(_Elementwise):
    """imputeValue in the place of NULL and of maskValue; in a column of strings both count as strings.

    A ValueError if one of them is no number and the column has numbers.
    """

    MOST = 1
    PARAMS = {"imputeValue": REQUIRED, "maskValue": None}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        if self.p("imputeValue") is None:
            raise ValueError("imputeValue may not be null")
        kind, mask = element(kinds[0]), self.p("maskValue")
        if isinstance(kind, T.StringType):
            value, mask = F.lit(self.p("imputeValue")).cast("string"), None if mask is None else F.lit(mask).cast("string")
        elif name_of(kind) in NUMBERS:
            value = F.lit(float(self.p("imputeValue"))).cast("double" if name_of(kind) in INTEGERS else kind)
            mask = None if mask is None else F.lit(float(mask))
        else:
            value, mask = F.lit(self.p("imputeValue")).cast(kind), None if mask is None else F.lit(mask).cast(kind)

        def leaf(x: Column) -> Column:
            missing = x.isNull() if mask is None else x.isNull() | (x == mask)
            return F.when(missing, value).otherwise(x)

        return map_leaf(cols, kinds, leaf)
