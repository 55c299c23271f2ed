"""Operators on arrays and on places on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.nested import map_inner
from loomwright.operators.elementwise import _Elementwise
from loomwright.stage import REQUIRED, Operator, at_least, number, one_of
from loomwright.types import FLOATS, NUMBERS, T, depth, element

#: The radius of the earth.
RADIUS = {"km": 6371.0, "miles": 3958.8}


def dot(a: Column, b: Column) -> Column:
    """The sum of the products of two arrays' elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class ArrayConcatenateTransformer(Operator):
    """All inputs in one array, on the innermost axis; scalars become arrays of one element.

    A scalar beside nested arrays is added to every innermost array.
    """

    PARAMS = {"autoBroadcast": False}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        deepest = max(map(depth, kinds))
        if deepest == 0:
            return F.array(*cols)
        if any(depth(k) not in (0, deepest) for k in kinds):
            raise ValueError(f"arrays of unequal nesting: {[k.simpleString() for k in kinds]}")
        scalars = {i: c for i, c in enumerate(cols) if depth(kinds[i]) == 0}
        arrays = [i for i in range(len(cols)) if i not in scalars]

        def together(*inner: Column) -> Column:
            found = dict(zip(arrays, inner, strict=True))
            return F.concat(*[found[i] if i in found else F.array(scalars[i]) for i in range(len(cols))])

        return map_inner([cols[i] for i in arrays], [kinds[i] for i in arrays], together)


class ArrayCropTransformer(Operator):
    """Innermost arrays, cropped or filled up to a length."""

    PARAMS = {"arrayLength": 128, "padValue": None}
    CHECKS = {"arrayLength": at_least(1)}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        n, pad = self.p("arrayLength"), self.p("padValue")
        kind = element(kinds[0])
        text = isinstance(kind, T.StringType)
        if pad is None:
            pad = "" if text else 0
        if isinstance(pad, str) != text:
            raise ValueError(f"padValue {pad!r} doesn't go with elements of type {kind.simpleString()}")
        fill = F.lit(pad).cast(kind)
        return map_inner(cols, kinds, lambda x: F.when(x.isNotNull(), F.concat(F.slice(x, 1, n), F.array_repeat(fill, F.lit(n) - F.size(x)))))


class ArrayReduceMaxTransformer(Operator):
    ACCEPTS = FLOATS
    PARAMS = {"defaultValue": 0.0}
    CHECKS = {"defaultValue": number}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        default = F.lit(self.p("defaultValue")).cast(element(kinds[0]))
        return map_inner(cols, kinds, lambda x: F.coalesce(F.array_max(x), default))


class ArraySplitTransformer(Operator):
    """One output for each place of the innermost arrays; NULL where an array is too short."""

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> list[Column]:
        return [_place(cols, kinds, i) for i in range(len(self.outputs()))]


def _place(cols: list[Column], kinds: list[T.DataType], i: int) -> Column:
    return map_inner(cols, kinds, lambda x: F.get(x, F.lit(i)))


class ArraySubtractMinimumTransformer(Operator):
    """Elements less the least of their innermost array, NULL where that overflows; padValue is passed over and stays."""

    ACCEPTS = NUMBERS
    PARAMS = {"padValue": None}
    CHECKS = {"padValue": number}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        pad = self.p("padValue")

        def less(x: Column) -> Column:
            if pad is None:
                least = F.array_min(x)
                return _bound(least, lambda m: F.transform(x, lambda y: F.try_subtract(y, m)))
            least = F.array_min(F.filter(x, lambda y: y != F.lit(pad)))
            return _bound(least, lambda m: F.transform(x, lambda y: F.when(y == F.lit(pad), y).otherwise(F.try_subtract(y, m))))

        return map_inner(cols, kinds, less)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for all elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class OrdinalArrayEncodeTransformer(Operator):
    """For each string, the number of other strings first seen before it in its array; padValue is -1."""

    ACCEPTS = ("string",)
    PARAMS = {"padValue": None}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        pad = self.p("padValue")

        def ordinals(x: Column) -> Column:
            if pad is None:
                seen = F.array_distinct(F.filter(x, lambda e: e.isNotNull()))
                return _bound(seen, lambda s: F.transform(x, lambda e: F.when(e.isNull(), -1).otherwise((F.array_position(s, e) - 1).cast("int"))))
            # A NULL is a value like any other here; it is marked, so that it can be compared.
            marked = F.transform(x, lambda e: F.struct(e.isNull().alias("n"), F.coalesce(e, F.lit("")).alias("v")))
            is_pad = lambda s: ~s["n"] & (s["v"] == F.lit(pad))
            seen = F.array_distinct(F.filter(marked, lambda s: ~is_pad(s)))
            return _bound(seen, lambda s: F.transform(marked, lambda e: F.when(is_pad(e), -1).otherwise((F.array_position(s, e) - 1).cast("int"))))

        return map_inner(cols, kinds, ordinals)


class CosineSimilarityTransformer(Operator):
    """The cosine of two arrays; 0 where it isn't defined."""

    ACCEPTS = FLOATS

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        if len(cols) != 2:
            raise ValueError("there must be two input columns")
        return map_inner(cols, kinds, lambda a, b: F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


class PairwiseCosineSimilarityTransformer(Operator):
    """The cosines of an array and each of the vectors that a second array holds one after the other."""

    ACCEPTS = FLOATS
    PARAMS = {"embeddingDim": REQUIRED}
    CHECKS = {"embeddingDim": at_least(1)}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        n = self.p("embeddingDim")
        if len(cols) != 2:
            raise ValueError("there must be two input columns")

        def cosines(query: Column, flat: Column) -> Column:
            def one(given: Column) -> Column:
                vector = lambda i: F.slice(flat, i * n + 1, F.lit(n))
                cosine = lambda v: F.coalesce(F.try_divide(dot(given["q"], v), given["norm"] * F.sqrt(dot(v, v))), F.lit(0.0))
                places = F.sequence(F.lit(0), F.floor(F.size(flat) / n).cast("int") - 1)
                return F.when(F.size(flat) < n, F.array().cast("array<double>")).otherwise(F.transform(places, lambda i: cosine(vector(i))))

            return _bound(F.struct(query.alias("q"), F.sqrt(dot(query, query)).alias("norm")), one)

        return map_inner(cols, kinds, cosines)


class _Places(_Elementwise):
    """Two places: four columns of degrees, or two and a constant; NULL where one is off the globe."""

    ACCEPTS, MOST, LEAST = FLOATS, 4, 4
    PARAMS = {"latLonConstant": None}

    @staticmethod
    def _checked(place: list[float]) -> list[float]:
        if len(place) != 2 or not (-90 <= place[0] <= 90 and -180 <= place[1] <= 180):
            raise ValueError("latLonConstant must be a latitude from -90 to 90 and a longitude from -180 to 180")
        return [float(v) for v in place]

    CHECKS = {"latLonConstant": lambda place: _Places._checked(place)}

    def with_constant(self, cols: list[Column], kinds: list[T.DataType]) -> tuple[list[Column], list[T.DataType]]:
        place = self.p("latLonConstant")
        if place is not None and len(cols) == 2:
            return [*cols, *map(F.lit, place)], [*kinds, T.DoubleType(), T.DoubleType()]
        return cols, kinds

    def leaf(self, *x: Column) -> Column:
        limits = (90, 180, 90, 180)
        radians = [F.radians(F.when(v.between(-most, most), v.cast("double"))) for v, most in zip(x, limits, strict=True)]
        return self.between(*radians)

    def between(self, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        raise NotImplementedError


class HaversineDistanceTransformer(_Places):
    PARAMS = {"unit": "km"}
    CHECKS = {"unit": one_of(*RADIUS)}

    def between(self, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        square = lambda c: c * c
        chord = square(F.sin((lat2 - lat1) / 2)) + F.cos(lat1) * F.cos(lat2) * square(F.sin((lon2 - lon1) / 2))
        return F.asin(F.sqrt(chord)) * 2 * RADIUS[self.p("unit")]


class BearingAngleTransformer(_Places):
    """Degrees, from 0 to 360, from north to the way from the first place to the second."""

    def between(self, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        east = F.sin(lon2 - lon1) * F.cos(lat2)
        north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
        return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))
