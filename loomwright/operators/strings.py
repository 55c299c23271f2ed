"""Operators on strings."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.nested import map_inner
from loomwright.operators.elementwise import _Elementwise
from loomwright.stage import REQUIRED, Operator, at_least, one_of
from loomwright.types import T


class _String(_Elementwise):
    ACCEPTS, MOST = ("string",), 1


class StringAffixTransformer(_String):
    PARAMS = {"prefix": None, "suffix": None}

    def leaf(self, x: Column) -> Column:
        prefix, suffix = self.p("prefix") or "", self.p("suffix") or ""
        if not prefix and not suffix:
            raise ValueError("prefix or suffix must be set")
        return F.concat(F.lit(prefix), x, F.lit(suffix))


class StringArrayConstantTransformer(_Elementwise):
    """The same array of strings for every element; the input's values don't matter."""

    MOST = 1
    PARAMS = {"constantStringArray": REQUIRED}

    def leaf(self, x: Column) -> Column:
        return F.array(*map(F.lit, self.p("constantStringArray")))


class StringCaseTransformer(_String):
    PARAMS = {"stringCaseType": "lower"}
    CHECKS = {"stringCaseType": one_of("lower", "upper")}

    def leaf(self, x: Column) -> Column:
        return F.lower(x) if self.p("stringCaseType") == "lower" else F.upper(x)


class StringConcatenateTransformer(_String):
    """All inputs, joined by the separator; NULLs are passed over."""

    MOST, LEAST = None, 2
    PARAMS = {"separator": "_"}

    def leaf(self, *x: Column) -> Column:
        return F.concat_ws(self.p("separator"), *x)


class _Negated(_String):
    PARAMS = {"negation": False}

    def holds(self, *x: Column) -> Column:
        raise NotImplementedError

    def leaf(self, *x: Column) -> Column:
        return ~self.holds(*x) if self.p("negation") else self.holds(*x)


class StringContainsTransformer(_Negated):
    """Whether the second string (a column or stringConstant) is in the first; an empty one is only in an empty one."""

    MOST, LEAST, CONSTANT = 2, 2, "stringConstant"
    PARAMS = {"stringConstant": None}

    def holds(self, x: Column, part: Column) -> Column:
        return F.when(part == "", x == "").otherwise(F.contains(x, part))


class StringContainsListTransformer(_Negated):
    PARAMS = {"constantStringArray": REQUIRED}

    def holds(self, x: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [x.contains(c) for c in self.p("constantStringArray")])


class StringIsInListTransformer(_Negated):
    PARAMS = {"constantStringArray": REQUIRED}

    def holds(self, x: Column) -> Column:
        return x.isin(list(self.p("constantStringArray")))


class StringListToStringTransformer(Operator):
    """The innermost arrays, joined by the separator; NULL elements are passed over."""

    ACCEPTS = ("string",)
    PARAMS = {"separator": ""}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        return map_inner(cols, kinds, lambda x: F.array_join(x, self.p("separator")))


class StringMapTransformer(_String):
    """The replacement of the first equal match value; else the default, or the string itself."""

    PARAMS = {"stringMatchValues": REQUIRED, "stringReplaceValues": REQUIRED, "defaultReplaceValue": None}

    def leaf(self, x: Column) -> Column:
        old, new, default = (self.p(k) for k in ("stringMatchValues", "stringReplaceValues", "defaultReplaceValue"))
        if len(old) != len(new):
            raise ValueError("stringMatchValues and stringReplaceValues must have equal lengths")
        out = x if default is None else F.lit(default)
        for a, b in reversed(list(zip(old, new, strict=True))):
            out = F.when(x == F.lit(a), F.lit(b)).otherwise(out)
        return out


class StringReplaceTransformer(_String):
    """All matches of a string, or of a regular expression, replaced.

    Match and replacement are constants, if those are set, or else the next input columns. An empty
    string matches everywhere between characters; an empty regular expression matches an empty string. Only a constant replacement
    of a regular expression may name groups ($1), which must be there; others are taken as they are.
    """

    MOST, LEAST = 3, 3
    PARAMS = {"stringMatchConstant": None, "stringReplaceConstant": None, "regex": False}

    def with_constant(self, cols: list[Column], kinds: list[T.DataType]) -> tuple[list[Column], list[T.DataType]]:
        left, out = list(zip(cols, kinds, strict=True)), []
        for constant in (None, "stringMatchConstant", "stringReplaceConstant"):
            value = self.p(constant) if constant else None
            if value is None and not left:
                raise ValueError(f"{constant} or one more input column must be set")
            out.append((F.lit(value), T.StringType()) if value is not None else left.pop(0))
        if left:
            raise ValueError("too many input columns")
        return [c for c, _ in out], [k for _, k in out]

    def _constant_groups(self) -> bool:
        """Whether the replacement is a constant that may name groups; a ValueError if it names one that isn't there."""
        new, pattern = self.p("stringReplaceConstant"), self.p("stringMatchConstant")
        if new is None or pattern is None:
            return False
        named = re.findall(r"\\.|\$\{\w+\}|\$\d|[\\$]", new)
        if any(n in ("$", "\\") for n in named) or any(n[1:].isdigit() and n[0] == "$" and int(n[1:]) > _groups(pattern) for n in named):
            raise ValueError(f"stringReplaceConstant {new!r} names a group that the pattern doesn't have")
        return True

    def leaf(self, x: Column, match: Column, new: Column) -> Column:
        quoted = F.regexp_replace(new, r"[\\$]", r"\\$0")
        if self.p("regex"):
            return F.when(match == "", F.when(x == "", new).otherwise(x)).otherwise(F.regexp_replace(x, match, new if self._constant_groups() else quoted))
        return F.when(match == "", F.regexp_replace(x, F.lit(""), quoted)).otherwise(F.replace(x, match, new))


def _groups(pattern: str) -> int:
    """Groups of a regular expression: opening brackets that are neither quoted, nor in a class, nor followed by a question mark."""
    plain = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)
    return len(re.findall(r"\((?!\?(?!<[A-Za-z]))", plain))


class StringToStringListTransformer(_String):
    """The parts between separators, cropped or filled up to listLength; empty parts become the default."""

    PARAMS = {"separator": ",", "listLength": 1, "defaultValue": ""}
    CHECKS = {"listLength": at_least(1)}

    def leaf(self, x: Column) -> Column:
        length, default = self.p("listLength"), F.lit(self.p("defaultValue"))
        parts = F.slice(F.split(x, re.escape(self.p("separator"))), 1, length)
        parts = F.transform(parts, lambda s: F.when(s == "", default).otherwise(s))
        return F.concat(parts, F.array_repeat(default, F.lit(length) - F.size(parts)))


class StringSequenceToEmbeddingTransformer(_String):
    """The numbers of ``f|f,f|f``, in order, as seqLen vectors of embeddingDim floats.

    Both separators part numbers alike; empty and missing ones are padValue, and what is no number
    is NULL. With ``reverse`` as many vectors as the string has parts that aren't empty come first, in
    reverse order.
    """

    PARAMS = {"seqLen": 10, "embeddingDim": 32, "separator": "|", "sequenceSeparator": ",", "padValue": "0", "reverse": False}

    @staticmethod
    def _numeric(text: str) -> str:
        float(text)
        return str(text)

    CHECKS = {"seqLen": at_least(1), "embeddingDim": at_least(1), "padValue": lambda v: StringSequenceToEmbeddingTransformer._numeric(v)}

    def leaf(self, x: Column) -> Column:
        n, dim, pad = self.p("seqLen"), self.p("embeddingDim"), F.lit(float(self.p("padValue"))).cast("float")
        one, many = re.escape(self.p("separator")), re.escape(self.p("sequenceSeparator"))
        if one == many:
            raise ValueError("separator and sequenceSeparator must differ")

        def vectors(made: Column) -> Column:
            def number(place: Column) -> Column:
                token = F.get(made["tokens"], place)
                return F.when(token.isNull() | (token == ""), pad).otherwise(token.try_cast("float"))

            def vector(i: Column) -> Column:
                i = F.when(i < made["first"], made["first"] - 1 - i).otherwise(i)
                return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: number(i * dim + j))

            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), vector)

        parts = F.filter(F.split(x, many), lambda s: s != "")
        first = F.least(F.size(parts), F.lit(n)) if self.p("reverse") else F.lit(0)
        made = F.struct(F.split(x, f"{one}|{many}").alias("tokens"), first.alias("first"))
        # One element, so that the tokens are split once for all places.
        return F.when(x.isNotNull(), F.get(F.transform(F.array(made), vectors), F.lit(0)))


class SubStringDelimAtIndexTransformer(_String):
    """The part at a place (from 0, or from -1 at the end), else the default; NULL gives the default."""

    PARAMS = {"delimiter": "_", "index": 0, "defaultValue": ""}

    def leaf(self, x: Column) -> Column:
        i = self.p("index")
        return F.coalesce(F.try_element_at(F.split(x, re.escape(self.p("delimiter"))), F.lit(i + 1 if i >= 0 else i)), F.lit(self.p("defaultValue")))

