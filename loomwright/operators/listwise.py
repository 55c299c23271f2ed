"""Statistics of the list that a row belongs to, as windows over the query column.

All statistics of a level are evaluated together, so those of one query column share an exchange.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.stage import REQUIRED, Operator, at_least, number, one_of
from loomwright.types import NUMBERS, T, column_type, depth


class _Listwise(Operator):
    """Every row of a list gets the statistic of the list's values that count.

    ``inputCols`` may name a second column: the one to sort by, of which the first topN count, or
    with withSegment one that parts the lists. Values under minFilterValue don't count. Where there
    is no result it is nanFillValue. Ties of the sort column are broken by ``tieBreakCols``.

    A window brings the rows of a list into one task. With ``skewSafe`` the statistic is aggregated
    first, partly before the shuffle, and joined to the rows, so that Spark can split a list that
    holds much of the table; it costs a second shuffle, and doesn't go with topN.
    """

    ACCEPTS = (*NUMBERS, "string")
    ROW_WISE = False
    #: Whether strings are taken as the numbers that they spell.
    NUMERIC = False
    PARAMS = {"queryIdCol": None, "topN": None, "sortOrder": "asc", "withSegment": False, "minFilterValue": None, "nanFillValue": 0.0, "tieBreakCols": None, "skewSafe": False}
    CHECKS = {"sortOrder": one_of("asc", "desc"), "topN": at_least(1), "minFilterValue": int, "nanFillValue": number}

    def statistic(self, x: Column) -> Column:
        raise NotImplementedError

    def operands(self, schema: T.StructType) -> tuple[list[Column], list[T.DataType]]:
        """The value column alone: the second column may be of any type."""
        col, kind = self.operand(schema, self.inputs()[0])
        return [col], [kind]

    def query(self, schema: T.StructType) -> str:
        if self.p("queryIdCol") is None:
            raise ValueError("queryIdCol must be set")
        for name in [self.p("queryIdCol"), *self.inputs()]:
            if depth(column_type(schema, name)):
                raise ValueError(f"{name} may not be an array")
        return self.p("queryIdCol")

    def _second(self) -> str | None:
        names = self.inputs()
        if len(names) > 2:
            raise ValueError("there may be a value column and one more")
        if len(names) == 2 and not self.p("withSegment") and self.p("topN") is None:
            raise ValueError("a second column needs topN or withSegment")
        return names[1] if len(names) == 2 else None

    def _place(self, schema: T.StructType) -> tuple[str, Column]:
        """Name and expression of the place in the order of the sort column."""
        query, by = self.query(schema), [F.col(self._second())]
        by = [c.asc() if self.p("sortOrder") == "asc" else c.desc() for c in by] + [F.col(c) for c in self.p("tieBreakCols") or []]
        name = "__lw_place_" + "_".join([query, self.inputs()[1], self.p("sortOrder"), *(self.p("tieBreakCols") or [])])
        return name, F.row_number().over(Window.partitionBy(query).orderBy(*by))

    def helpers(self, schema: T.StructType) -> dict[str, Column]:
        return dict([self._place(schema)]) if self._second() is not None and not self.p("withSegment") else {}

    def _counted(self, schema: T.StructType) -> Column:
        """The value where it counts, else NULL."""
        (x,), (kind,) = self.operands(schema)
        number, counts = x.try_cast("double") if kind.simpleString() == "string" else x, []
        x = number if self.NUMERIC else x
        if self._second() is not None and not self.p("withSegment"):
            counts.append(F.col(f"`{self._place(schema)[0]}`") <= self.p("topN"))
        if self.p("minFilterValue") is not None:
            counts.append(number >= F.lit(self.p("minFilterValue")))
        for condition in counts:
            x = F.when(condition, x)
        return x

    def _keys(self, schema: T.StructType) -> list[str]:
        query, second = self.query(schema), self._second()
        if self.p("withSegment") and second is None:
            raise ValueError("withSegment needs a second column")
        return [query, second] if self.p("withSegment") else [query]

    def before(self, df: DataFrame) -> DataFrame:
        if not self.p("skewSafe"):
            return df
        keys = self._keys(df.schema)
        if self._second() is not None and not self.p("withSegment"):
            raise ValueError("skewSafe doesn't go with topN")
        inner = {k: f"__lw_key_{i}" for i, k in enumerate(keys)}
        found = df.groupBy(*[F.col(k).alias(n) for k, n in inner.items()]).agg(self.statistic(self._counted(df.schema)).alias(f"__lw_{self.uid}"))
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in inner.items()])
        return df.join(found, same, "left").drop(*inner.values())

    def expressions(self, schema: T.StructType) -> dict[str, Column]:
        keys = self._keys(schema)
        if self.p("skewSafe"):
            found = F.col(f"`__lw_{self.uid}`")
        else:
            found = self.statistic(self._counted(schema)).over(Window.partitionBy(*keys))
        fill, kind = self.p("nanFillValue"), self.operands(schema)[1][0].simpleString()
        if kind in ("float", "double"):
            found = F.nanvl(found, F.lit(None).cast("double"))
        if kind == "string" and not self.NUMERIC:
            return {self.outputs()[0]: found}  # no number can fill it
        return {self.outputs()[0]: F.coalesce(found, F.lit(fill)) if fill is not None else found}


class ListMaxTransformer(_Listwise):
    def statistic(self, x: Column) -> Column:
        return F.max(x)


class ListMinTransformer(_Listwise):
    def statistic(self, x: Column) -> Column:
        return F.min(x)


class ListMeanTransformer(_Listwise):
    NUMERIC = True

    def statistic(self, x: Column) -> Column:
        return F.mean(x)


class ListMedianTransformer(_Listwise):
    ACCEPTS = NUMBERS

    def statistic(self, x: Column) -> Column:
        return F.median(x)


class ListStdDevTransformer(_Listwise):
    ACCEPTS = NUMBERS

    def statistic(self, x: Column) -> Column:
        return F.stddev(x)


class ListRankTransformer(Operator):
    """The place of a row's value in its list, from 1; ties are broken by ``tieBreakCols``."""

    ACCEPTS = NUMBERS
    ROW_WISE = False
    PARAMS = {"queryIdCol": REQUIRED, "sortOrder": "desc", "tieBreakCols": None}
    CHECKS = {"sortOrder": one_of("asc", "desc")}

    def helpers(self, schema: T.StructType) -> dict[str, Column]:
        # Made below the unordered windows of the level, which then need no sort of their own.
        cols, kinds = self.operands(schema)
        if depth(kinds[0]):
            raise ValueError("the value may not be an array")
        by = cols[0].asc() if self.p("sortOrder") == "asc" else cols[0].desc()
        order = Window.partitionBy(self.p("queryIdCol")).orderBy(by, *map(F.col, self.p("tieBreakCols") or []))
        return {f"__lw_{self.uid}": F.row_number().over(order)}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        return F.col(f"`__lw_{self.uid}`")
