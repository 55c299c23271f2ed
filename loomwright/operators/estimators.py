"""Estimators: stages that learn the parameters of an operator."""

from __future__ import annotations

import math
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.means import PARTS, USUAL, exponent_of, mean_of, sums_of_parts
from loomwright.nested import map_leaf
from loomwright.operators import elementwise, encoding, scaling
from loomwright.stage import CONDITIONS, REQUIRED, Learner, Operator, at_least, number, one_of
from loomwright.types import FLOATS, NUMBERS, T, depth


#: Most labels that a vocabulary has without maxNumLabels: they are a parameter, which the driver holds.
MOST_LABELS = 5_000_000
#: Most places of which parts for exact means are added up with everything else.
MOST_PLACES = 8


def _fraction(value: float) -> float:
    if not 0 < value < 1:
        raise ValueError("sampleFraction must lie between 0 and 1")
    return float(value)


class _Numeric(Learner):
    """Learns from numbers, or from a sample of the rows (repeatable with sampleSeed)."""

    ACCEPTS = FLOATS
    PARAMS: ClassVar[dict] = {"sampleFraction": None, "sampleSeed": None}
    CHECKS: ClassVar[dict] = {"sampleFraction": _fraction}

    def elements(self, df: DataFrame, width: int) -> tuple[DataFrame, list[Column]]:
        """Rows and, for each place, the column of its elements; arrays nested deeper are exploded."""
        cols, kinds = self.operands(df.schema)
        levels = depth(kinds[0])
        if levels == 0:
            return df, [cols[0]]
        if levels > 1:
            name, col = f"__lw_{self.uid}", cols[0]
            for _ in range(levels - 2):
                col = F.flatten(col)
            if name not in df.columns:
                df = df.withColumn(name, F.explode(col))
            return df, [F.get(F.col(name), F.lit(i)) for i in range(width)]
        return df, [F.get(cols[0], F.lit(i)) for i in range(width)]

    def unmasked(self, x: Column) -> Column:
        mask = self.p("maskValue") if "maskValue" in self.ALL else None
        return x if mask is None else F.when(x != F.lit(mask), x)

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        raise NotImplementedError

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        raise NotImplementedError


class StandardScaleEstimator(_Numeric):
    """Mean and population deviation of each place, without maskValue.

    The mean doesn't depend on how the rows are dealt to tasks (beyond 2**37 rows, of which the parts
    may not fit, it is Spark's); the deviation may, in its last digits.
    """

    MODEL = scaling.StandardScaleTransformer
    PARAMS: ClassVar[dict] = {"maskValue": None}
    CHECKS: ClassVar[dict] = {"maskValue": number}

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        df, places = self.elements(df, width)
        values = {i: self.unmasked(x) for i, x in enumerate(places)}
        out = {f"{k}{i}": fn(x) for i, x in values.items() for k, fn in (("m", F.avg), ("s", F.stddev_pop))}
        out |= {f"most{i}": F.max(F.abs(x)) for i, x in values.items()}
        for i, x in values.items() if width <= MOST_PLACES else ():
            out |= {f"n{i}": F.count(x), **{f"part{k}_{i}": c for k, c in enumerate(sums_of_parts(x, USUAL))}}
        return df, out

    def refine(self, df: DataFrame, found: dict[str, Any]) -> dict[str, Any]:
        """The means, made exact; places of unusually great or small numbers, and many places, are added up once more for that."""
        found, width = dict(found), sum(k.startswith("most") for k in found)
        grids = {i: exponent_of(v) for i in range(width) if (v := found[f"most{i}"]) is not None and math.isfinite(v)}
        if again := [i for i, e in grids.items() if e != USUAL or f"n{i}" not in found]:
            df, places = self.elements(df, width)
            factors = F.array(*[F.lit(2.0 ** -grids[i]) for i in again])
            df = df.select(F.posexplode(F.array(*[self.unmasked(places[i]) for i in again])).alias("place", "x"))
            sums = sums_of_parts(F.col("x") * F.get(factors, F.col("place")), 0)
            for r in df.groupBy("place").agg(F.count("x").alias("n"), *[c.alias(f"part{k}_") for k, c in enumerate(sums)]).collect():
                found |= {f"{k}{again[r['place']]}": v for k, v in r.asDict().items() if k != "place"}
        for i, e in grids.items():
            sums = [found[f"part{k}_{i}"] for k in range(PARTS)]
            if None not in sums:
                found[f"m{i}"] = mean_of(sums, found[f"n{i}"], e)
        return found

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        return self.model(mean=[found[f"m{i}"] for i in range(width)], stddev=[found[f"s{i}"] for i in range(width)])


class SingleFeatureArrayStandardScaleEstimator(StandardScaleEstimator):
    """One mean and deviation of all elements, for every place."""

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        cols, kinds = self.operands(df.schema)
        if not depth(kinds[0]):
            raise TypeError("an array is needed")
        col = cols[0]
        for _ in range(depth(kinds[0]) - 1):
            col = F.flatten(col)
        # Partial sums in each row, so that nothing is exploded. They are taken about the array's own
        # mean, which keeps digits when the deviation is small against the mean.
        used = F.filter(F.transform(col, lambda x: self.unmasked(x).cast("double")), lambda x: x.isNotNull())

        def moments(x: Column) -> Column:
            n = F.size(x)
            mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), n)
            spread = F.get(F.transform(F.array(mean), lambda m: F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - m) * (b - m))), F.lit(0))
            return F.struct(n.alias("n"), mean.alias("mean"), spread.alias("spread"))

        name = f"__lw_{self.uid}"
        df = df.withColumn(name, F.get(F.transform(F.array(used), moments), F.lit(0)))
        n, mean = F.col(f"{name}.n"), F.col(f"{name}.mean")
        return df, {"n": F.sum(n), "sum": F.sum(mean * n), "within": F.sum(f"{name}.spread"), "square": F.sum(mean * mean * n)}

    def refine(self, df: DataFrame, found: dict[str, Any]) -> dict[str, Any]:
        return found

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        if not found["n"]:
            raise ValueError("there are no elements to learn from")
        mean = found["sum"] / found["n"]
        deviation = math.sqrt(max((found["within"] + found["square"]) / found["n"] - mean * mean, 0.0))
        return self.model(mean=[mean] * width, stddev=[deviation] * width)


class MinMaxScaleEstimator(_Numeric):
    """Least and greatest element of each place, without maskValue."""

    MODEL = scaling.MinMaxScaleTransformer
    PARAMS: ClassVar[dict] = {"maskValue": None}
    CHECKS: ClassVar[dict] = {"maskValue": number}

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        df, places = self.elements(df, width)
        return df, {f"{k}{i}": fn(self.unmasked(x)) for i, x in enumerate(places) for k, fn in (("a", F.min), ("z", F.max))}

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        return self.model(min=[found[f"a{i}"] for i in range(width)], max=[found[f"z{i}"] for i in range(width)])


class ConditionalStandardScaleEstimator(_Numeric):
    """Moments of the rows where every mask column compares with its value as its operator says.

    ``scalingFunction="standard"``: mean and population deviation, of rows with relevanceCol > 0 if
    that is set, and without what is within epsilon of 0 if skipZeros is. ``"binary"``: for n ones, f
    of them with relevanceCol > 0, a mean of 1 - f/n and the sample deviation of f ones in n.
    Moments that don't exist are nanFillValue.
    """

    MODEL = scaling.ConditionalStandardScaleTransformer
    PARAMS: ClassVar[dict] = {
        "scalingFunction": "standard", "maskCols": None, "maskOperators": None, "maskValues": None, "relevanceCol": None,
        "skipZeros": False, "epsilon": 0.0, "nanFillValue": None,
    }
    CHECKS: ClassVar[dict] = {
        "scalingFunction": lambda v: one_of("standard", "binary")(v.lower()), "maskOperators": lambda v: [one_of(*CONDITIONS)(x) for x in v],
        "epsilon": number, "nanFillValue": number,
    }

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        masks = [self.p(k) for k in ("maskCols", "maskOperators", "maskValues")]
        counts = F.lit(True)
        if any(m is not None for m in masks):
            if any(m is None or len(m) != len(masks[0] or []) for m in masks):
                raise ValueError("maskCols, maskOperators and maskValues must be set together, with equal lengths")
            for name, condition, value in zip(*masks, strict=True):
                if name not in df.columns:
                    raise ValueError(f"there is no mask column {name!r}")
                counts &= CONDITIONS[condition](F.col(name), F.lit(value))
        relevance = self.p("relevanceCol")
        df, places = self.elements(df, width)
        out = {"rows": F.sum(F.when(counts, 1).otherwise(0))}
        if self.p("scalingFunction") == "binary":
            if relevance is None:
                raise ValueError("binary scaling needs relevanceCol")
            for i, x in enumerate(places):
                out[f"n{i}"] = F.sum(F.when(counts & (x == 1), 1).otherwise(0))
                out[f"f{i}"] = F.sum(F.when(counts & (x == 1) & (F.col(relevance) > 0), 1).otherwise(0))
            return df, out
        if relevance is not None:
            counts &= F.col(relevance) > 0
        for i, x in enumerate(places):
            used = F.when(counts & (F.abs(x) > F.lit(self.p("epsilon"))) if self.p("skipZeros") else counts, x)
            out |= {f"m{i}": F.avg(used), f"s{i}": F.stddev_pop(used)}
        return df, out

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        if not found["rows"]:
            raise ValueError("no row is left by the mask conditions")
        if self.p("scalingFunction") == "binary":
            moments = [_binary(found[f"f{i}"], found[f"n{i}"]) for i in range(width)]
        else:
            moments = [(found[f"m{i}"], found[f"s{i}"]) for i in range(width)]
        fill = self.p("nanFillValue")
        filled = [[fill if v is None else v for v in column] for column in zip(*moments, strict=True)]
        return self.model(mean=filled[0], stddev=filled[1])


def _binary(f: float, n: float) -> tuple[float | None, float | None]:
    if not n:
        return None, None
    share = f / n
    spread = f * (1 - share) ** 2 + (n - f) * share**2
    return 1 - share, math.sqrt(spread / (n - 1)) if n > 1 else None


class ImputeEstimator(_Numeric):
    """Mean or exact median of all elements that are neither NULL nor maskValue.

    The median is closed in on: a sketch of bounded size gives limits around it, what lies below them
    is counted, and what lies between is either little enough to be counted value by value or closed
    in on again. No task holds all values.
    """

    MODEL = elementwise.ImputeTransformer
    ACCEPTS = NUMBERS
    PARAMS: ClassVar[dict] = {"imputeMethod": REQUIRED, "maskValue": None}
    CHECKS: ClassVar[dict] = {"imputeMethod": one_of("mean", "median")}

    def aggregates(self, df: DataFrame, width: int) -> tuple[DataFrame, dict[str, Column]]:
        cols, kinds = self.operands(df.schema)
        levels, col = depth(kinds[0]), cols[0]
        if levels:
            for _ in range(levels - 1):
                col = F.flatten(col)
            name = f"__lw_{self.uid}"
            df, col = df.withColumn(name, F.explode_outer(col)), F.col(name)
        used = self.unmasked(col)
        if self.p("imputeMethod") == "mean":
            return df, {"value": F.avg(used)}
        name = f"__lw_value_{self.uid}"
        return df.withColumn(name, used.cast("double")), {"value": F.percentile_approx(F.col(name), F.array(*map(F.lit, AROUND)), F.lit(ACCURACY)), "n": F.count(name)}

    def refine(self, df: DataFrame, found: dict[str, Any]) -> dict[str, Any]:
        """The exact median, from limits around it."""
        if self.p("imputeMethod") == "mean" or not found["n"]:
            return found
        x, n, below = F.col(f"__lw_value_{self.uid}"), found["n"], 0
        wanted, limits, rows = [(n - 1) // 2, n // 2], found["value"], df
        while True:
            low, high = limits[0], limits[-1]
            inside = rows.where(x.between(low, high))
            row = rows.agg(F.sum(F.when(x < low, 1).otherwise(0)).alias("less"), F.sum(F.when(x.between(low, high), 1).otherwise(0)).alias("in")).first()
            if not below + row["less"] <= wanted[0] <= wanted[1] < below + row["less"] + row["in"]:
                # The sketch was off: everything on the side that was missed counts again.
                inside, row = rows, {"less": 0, "in": None}
            below, rows = below + row["less"], inside
            counts = rows.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
            few = counts.orderBy("v").limit(MOST_VALUES + 1).collect()
            if len(few) <= MOST_VALUES:
                return {"value": sum(_ranked(few, k - below) for k in wanted) / 2}
            share = [(wanted[0] - below) / max(rows.where(x.isNotNull()).count(), 1)]
            limits = rows.agg(F.percentile_approx(x, F.array(*[F.lit(min(max(share[0] + d, 0.0), 1.0)) for d in (-MARGIN, MARGIN)]), F.lit(ACCURACY)).alias("l")).first()["l"]

    def learn(self, found: dict[str, Any], width: int) -> Operator:
        if found["value"] is None:
            raise ValueError("there are no elements to learn from")
        return self.model(imputeValue=found["value"])


#: Accuracy of the sketch of percentiles, the share of rows on either side of the median that it closes in to, and the shares asked for.
ACCURACY, MARGIN = 10_000, 0.001
AROUND = (0.5 - MARGIN, 0.5 + MARGIN)
#: Distinct values that are counted one by one.
MOST_VALUES = 100_000


def _ranked(counts: list[Any], place: int) -> float:
    """The value at a place (from 0) of values in order, each with its count."""
    for r in counts:
        place -= r["c"]
        if place < 0:
            return r["v"]
    raise AssertionError("the place lies beyond the values")


class _Labels(Learner):
    """Learns the labels, in an order of which ties are broken by the label; NULL and the mask token are none."""

    ACCEPTS = ("string",)
    PARAMS: ClassVar[dict] = {"stringOrderType": "frequencyDesc", "maskToken": None, "numOOVIndices": 1, "maxNumLabels": None}
    CHECKS: ClassVar[dict] = {"stringOrderType": one_of(*encoding.ORDERS), "numOOVIndices": at_least(1), "maxNumLabels": at_least(1)}

    def labels(self, schema: T.StructType) -> list[tuple[Column, bool]]:
        """For each input a row's label, or (marked by True) the array of its labels."""
        out = []
        for col, kind in zip(*self.operands(schema), strict=True):
            text = map_leaf([col], [kind], lambda x: x.cast("string"))
            for _ in range(depth(kind) - 1):
                text = F.flatten(text)
            out.append((text, depth(kind) > 0))
        return out

    def learn(self, counts: DataFrame) -> Operator:
        if self.p("maskToken") is not None:
            counts = counts.where(F.col("label") != self.p("maskToken"))
        order = self.p("stringOrderType")
        first = F.col("n" if order.startswith("frequency") else "label")
        counts = counts.orderBy(first.asc() if order.endswith("Asc") else first.desc(), "label")
        most = self.p("maxNumLabels")
        found = [r["label"] for r in counts.select("label").limit(MOST_LABELS + 1 if most is None else most).collect()]
        if most is None and len(found) > MOST_LABELS:
            raise ValueError(f"there are more than {MOST_LABELS} labels; maxNumLabels must be set")
        return self.model(labelsArray=found)


class StringIndexEstimator(_Labels):
    MODEL = encoding.StringIndexTransformer


class SharedStringIndexEstimator(_Labels):
    MODEL = encoding.SharedStringIndexTransformer


class OneHotEncodeEstimator(_Labels):
    MODEL = encoding.OneHotEncodeTransformer
    ACCEPTS = ("smallint", "int", "bigint", "string")
    PARAMS: ClassVar[dict] = {"dropUnseen": False}


class SharedOneHotEncodeEstimator(OneHotEncodeEstimator):
    MODEL = encoding.SharedOneHotEncodeTransformer
