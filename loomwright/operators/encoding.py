"""Hashes and vocabularies of strings.

Hashes need a Python function, which works on Arrow batches. Vocabularies stay in the JVM: short
ones are looked up in a literal array, longer ones by a join with the labels, which are a parameter of
the stage: by broadcast up to BROADCAST_BYTES, by a shuffle beyond. Only labels outside the vocabulary that are to be
spread over several places are hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.farmhash import each, hash_texts, over_batches
from loomwright.nested import map_leaf
from loomwright.stage import REQUIRED, Operator, at_least, one_of
from loomwright.types import T, depth

if TYPE_CHECKING:
    import numpy as np

#: Labels up to which a vocabulary is a literal array.
LITERAL_LABELS = 100
#: Bytes of labels (with 32 for each label) up to which they are broadcast.
BROADCAST_BYTES = 64_000_000
#: Bins of a hash that is not binned.
MOST_BINS = 2**31 - 1
ORDERS = ("frequencyAsc", "frequencyDesc", "alphabeticalAsc", "alphabeticalDesc")


def python_column(col: Column, kind: T.DataType, many: Callable[[list[Any]], Sequence[Any]], leaf: str, inner: bool = False) -> Column:
    """``many`` of the distinct elements of a batch (or, with ``inner``, of all its innermost arrays), by a function of Arrow batches.

    ``leaf`` is the type of a result.
    """
    import pyarrow as pa

    levels = depth(kind) - inner
    made = "array<" * levels + leaf + ">" * levels
    arrow = _arrow(made)
    run = over_batches(many, levels) if not inner else over_batches(lambda found: many([None if x is None else list(x) for x in found]), levels)
    if inner:  # lists can't be looked up, so their elements are tuples

        def batches(found: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in found:
                rows = [each(x, levels, lambda y: None if y is None else tuple(y)) for x in batch.to_pylist()]
                yield from (x.cast(arrow) for x in run(iter([_Rows(rows)])))
    else:

        def batches(found: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for out in run(found):
                yield out.cast(arrow) if out.type != arrow else out

    batches.__annotations__ = {"found": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, made)(col)


class _Rows(list):
    """Values in the place of an Arrow array."""

    def to_pylist(self) -> list[Any]:
        return self


def _indices(texts: list[str | None], mask: str | None, bins: int, salts: Sequence[str] = ("",)) -> np.ndarray:
    """text x salt: 1 plus the hash of the salted text modulo bins - 1; 0 for NULL and the mask."""
    import numpy as np

    used = [i for i, x in enumerate(texts) if x is not None and x != mask]
    out = np.zeros((len(texts), len(salts)), dtype=np.int64)
    hashed = hash_texts([f"{texts[i]}{salt}" for i in used for salt in salts]).reshape(len(used), len(salts))
    out[used] = (hashed % np.uint64(bins - 1)).astype(np.int64) + 1
    return out


def _arrow(kind: str):
    import pyarrow as pa

    plain = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32()}
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else plain[kind]


class _Hashed(Operator):
    ACCEPTS = ("string",)
    USES_UDF = True


class HashIndexTransformer(_Hashed):
    """1 plus the hash modulo numBins - 1; NULL and maskValue are 0."""

    PARAMS = {"numBins": REQUIRED, "maskValue": None}
    CHECKS = {"numBins": at_least(2)}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        bins, mask = self.p("numBins"), self.p("maskValue")
        return python_column(cols[0], kinds[0], lambda texts: _indices(texts, mask, bins)[:, 0].tolist(), "int")


class BloomEncodeTransformer(_Hashed):
    """Several hash indices of every string, salted with their number."""

    PARAMS = {"numHashFns": 3, "numBins": None, "maskValue": None, "featureCardinality": None, "useHeuristicNumBins": False}
    CHECKS = {"numHashFns": at_least(2), "numBins": at_least(2)}

    def bins(self) -> int:
        if self.p("useHeuristicNumBins"):
            if self.p("featureCardinality") is None:
                raise ValueError("featureCardinality must be set to work out numBins")
            return max(round(0.2 * self.p("featureCardinality")), 2)
        if self.p("numBins") is None:
            raise ValueError("numBins or useHeuristicNumBins must be set")
        return self.p("numBins")

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        bins, mask, salts = self.bins(), self.p("maskValue"), [str(i) for i in range(self.p("numHashFns"))]
        return python_column(cols[0], kinds[0], lambda texts: _indices(texts, mask, bins, salts).tolist(), "array<int>")


class MinHashIndexTransformer(_Hashed):
    """For each permutation the lowest bit of the least hash index of the innermost array's strings, salted with its number.

    NULLs and maskValue are passed over; an array with nothing else counts as one empty string.
    """

    PARAMS = {"numPermutations": 128, "maskValue": None}
    CHECKS = {"numPermutations": at_least(1)}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        if not depth(kinds[0]):
            raise ValueError("an array of strings is needed")
        mask, salts = self.p("maskValue"), [str(i) for i in range(self.p("numPermutations"))]

        def bits(arrays: list[list[str | None] | None]) -> list[list[int] | None]:
            labels = list(dict.fromkeys(x for a in arrays for x in a or [] if x is not None and x != mask)) + [""]
            place, made = {x: i for i, x in enumerate(labels)}, []
            index = _indices(labels, None, MOST_BINS, salts)
            for a in arrays:
                used = {x for x in a or [] if x is not None}
                judged = [place[x] for x in used if x != mask]
                if a is None:
                    made.append(None)
                elif used and not judged:  # masked strings count as the greatest index
                    made.append([MOST_BINS & 1] * len(salts))
                else:
                    made.append((index[judged or [len(labels) - 1]].min(axis=0) & 1).tolist())
            return made

        return python_column(cols[0], kinds[0], bits, "array<int>", inner=True)


class _Vocabulary(Operator):
    """Shared: the index of a label.

    NULL and the mask token are 0; then, after the mask's place, come numOOVIndices places for other
    strings, and the labels. Several inputCols with as many outputCols share the labels.
    """

    ACCEPTS = ("string",)
    PARAMS = {"labelsArray": REQUIRED, "stringOrderType": "frequencyDesc", "maskToken": None, "numOOVIndices": 1}
    CHECKS = {"labelsArray": list, "stringOrderType": one_of(*ORDERS), "numOOVIndices": at_least(1)}

    @property
    def USES_UDF(self) -> bool:  # noqa: N802
        return self.isDefined("numOOVIndices") and self.p("numOOVIndices") > 1

    def start(self) -> int:
        return 0 if self.p("maskToken") is None else 1

    def _joined(self, name: str, kind: T.DataType) -> str | None:
        """The column that a join with the labels adds for an input, if it is looked up that way."""
        long = len(self.p("labelsArray")) > LITERAL_LABELS
        return f"__lw_{self.uid}_{self.inputs().index(name)}" if long and depth(kind) == 0 else None

    def before(self, df: DataFrame) -> DataFrame:
        cols, kinds = self.operands(df.schema)
        for name, col, kind in zip(self.inputs(), cols, kinds, strict=True):
            if (added := self._joined(name, kind)) is not None:
                first: dict[str, int] = {}
                for i, label in enumerate(self.p("labelsArray")):
                    first.setdefault(label, i)
                rows = df.sparkSession.createDataFrame(list(first.items()), f"{added}_label string, {added} int")
                rows = F.broadcast(rows) if sum(32 + len(x.encode()) for x in first) <= BROADCAST_BYTES else rows
                df = df.withColumn(f"{added}_key", col.cast("string")).join(rows, F.col(f"{added}_key") == F.col(f"{added}_label"), "left")
                df = df.drop(f"{added}_key", f"{added}_label")
        return df

    def index(self, name: str, col: Column, kind: T.DataType) -> Column:
        labels, oov, start, mask = self.p("labelsArray"), self.p("numOOVIndices"), self.start(), self.p("maskToken")
        if depth(kind) and len(labels) > LITERAL_LABELS:
            places = {x: i for i, x in reversed(list(enumerate(labels)))}

            def place(x: str | None, spread: int) -> int:
                if x is None or (mask is not None and x == mask):
                    return 0
                return places[x] + oov + start if x in places else spread + start

            return python_column(col, kind, lambda texts: [place(x, n) for x, n in zip(texts, _spread(texts, oov), strict=True)], "int")
        hashed = python_column(col, kind, lambda texts: _spread(texts, oov), "int") if oov > 1 else None
        added = self._joined(name, kind)

        def leaf(x: Column, *other: Column) -> Column:
            if added is not None:
                found = F.col(added)
            else:
                at = F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), x.cast("string"))
                found = F.when(at > 0, (at - 1).cast("int"))
            unseen = other[0] + F.lit(start) if other else F.lit(start)
            known = F.coalesce(found + F.lit(oov + start), unseen).cast("int")
            return F.when(x.isNull() if mask is None else x.isNull() | (x.cast("string") == F.lit(mask)), F.lit(0)).otherwise(known)

        return map_leaf([col, hashed], [kind, _int(kind)], leaf) if hashed is not None else map_leaf([col], [kind], leaf)

    def encode(self, name: str, col: Column, kind: T.DataType) -> Column:
        return self.index(name, col, kind)

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> list[Column]:
        return [self.encode(n, c, k) for n, c, k in zip(self.inputs(), cols, kinds, strict=True)]


def _spread(texts: list[str | None], places: int) -> list[int]:
    """The hash of each text modulo the number of places; 0 for NULL, and if there is one place."""
    import numpy as np

    used = [i for i, x in enumerate(texts) if x is not None] if places > 1 else []
    out = np.zeros(len(texts), dtype=np.int64)
    out[used] = (hash_texts([texts[i] for i in used]) % np.uint64(places)).astype(np.int64)
    return out.tolist()


def _int(kind: T.DataType) -> T.DataType:
    return T.ArrayType(_int(kind.elementType)) if isinstance(kind, T.ArrayType) else T.IntegerType()


class StringIndexTransformer(_Vocabulary):
    pass


class SharedStringIndexTransformer(_Vocabulary):
    pass


class _OneHot(_Vocabulary):
    """An array of 0.0 with 1.0 at the index; with dropUnseen without the places before the labels."""

    ACCEPTS = ("smallint", "int", "bigint", "string")
    PARAMS = {"dropUnseen": False}

    def encode(self, name: str, col: Column, kind: T.DataType) -> Column:
        if T.StringType() != _leaf(kind):
            col, kind = map_leaf([col], [kind], lambda x: x.cast("string")), _text(kind)
        skip = self.p("numOOVIndices") + self.start() if self.p("dropUnseen") else 0
        width = len(self.p("labelsArray")) + (0 if self.p("dropUnseen") else self.p("numOOVIndices") + self.start())
        index = self.index(name, col, kind)
        zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

        def one(i: Column) -> Column:
            hot = F.concat(zeros(i - skip), F.array(F.lit(1.0).cast("float")), zeros(F.lit(width - 1 + skip) - i))
            return F.when(i >= skip, hot).otherwise(zeros(F.lit(width))) if skip else hot

        empty = F.array().cast("array<float>")
        return map_leaf([index], [_int(kind)], one if width else lambda i: empty)


def _leaf(kind: T.DataType) -> T.DataType:
    return _leaf(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def _text(kind: T.DataType) -> T.DataType:
    return T.ArrayType(_text(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


class OneHotEncodeTransformer(_OneHot):
    pass


class SharedOneHotEncodeTransformer(_OneHot):
    pass


