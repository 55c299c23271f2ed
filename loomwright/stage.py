"""Stages: operators and estimators, their parameters, and the registry of both."""

from __future__ import annotations

import copy
import operator as op
from collections.abc import Callable, Iterable
from typing import Any, ClassVar

from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.casts import cast_elements
from loomwright.types import TYPES, T, column_type, require_type

REQUIRED = object()
#: Names of comparisons in parameters.
CONDITIONS: dict[str, Callable[[Any, Any], Any]] = {"eq": op.eq, "neq": op.ne, "lt": op.lt, "leq": op.le, "gt": op.gt, "geq": op.ge}
REGISTRY: dict[str, type[Stage]] = {}


def one_of(*values: Any) -> Callable[[Any], Any]:
    def check(value: Any) -> Any:
        if value not in values:
            raise ValueError(f"{value!r} is none of {', '.join(map(str, values))}")
        return value

    return check


def at_least(least: float) -> Callable[[Any], Any]:
    def check(value: Any) -> Any:
        if value is not None and value < least:
            raise ValueError(f"{value!r} is less than {least}")
        return value

    return check


def no_nulls(values: Any) -> Any:
    if values is None or any(v is None for v in values):
        raise ValueError("the values may not be null")
    return [float(v) for v in values]


def number(value: Any) -> float | None:
    return None if value is None else float(value)


def seconds_or_millis(value: Any) -> str:
    short = {"s": "s", "seconds": "s", "ms": "ms", "milliseconds": "ms"}
    return short[one_of(*short)(value)]


class Stage(Params):
    """A step with named parameters, each with a getX and a setX, that reads and makes columns."""

    #: Parameters and their defaults (REQUIRED: none), and checks that return the value to keep.
    PARAMS: ClassVar[dict[str, Any]] = {}
    CHECKS: ClassVar[dict[str, Callable[[Any], Any]]] = {}
    #: Element types that inputs may have; None: all.
    ACCEPTS: ClassVar[tuple[str, ...] | None] = None
    COMMON: ClassVar[dict[str, Any]] = {"inputCol": None, "inputCols": None, "outputCol": None, "outputCols": None, "inputDtype": None, "outputDtype": None, "layerName": None}

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        cls.ALL = {k: v for c in reversed(cls.__mro__) for k, v in {**c.__dict__.get("COMMON", {}), **c.__dict__.get("PARAMS", {})}.items()}
        cls.ALL_CHECKS = {k: v for c in reversed(cls.__mro__) for k, v in c.__dict__.get("CHECKS", {}).items()}
        for name in cls.ALL:
            title = name[0].upper() + name[1:]
            if not isinstance(cls.__dict__.get(name), Param):
                setattr(cls, name, Param(Params._dummy(), name, name))
            if f"get{title}" not in cls.__dict__:
                setattr(cls, f"get{title}", lambda self, name=name: self.getOrDefault(name) if self.isDefined(name) else None)
            if f"set{title}" not in cls.__dict__:
                setattr(cls, f"set{title}", lambda self, value, name=name: self.setParams(**{name: value}))
        if cls.__name__.endswith(("Transformer", "Estimator")):
            REGISTRY[cls.__name__] = cls

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(**{k: v for k, v in self.ALL.items() if v is not REQUIRED})
        self._setDefault(layerName=self.uid)
        self.setParams(**kwargs)

    def setParams(self, **kwargs: Any):  # noqa: N802
        for name, value in kwargs.items():
            if name not in self.ALL:
                raise TypeError(f"{type(self).__name__} has no parameter {name!r}")
            if name in ("inputDtype", "outputDtype") and value is not None:
                one_of(*TYPES)(value)
                if name == "inputDtype" and self.ACCEPTS is not None and value not in self.ACCEPTS:
                    raise ValueError(f"{type(self).__name__} does not accept elements of type {value}")
            check = self.ALL_CHECKS.get(name)
            self._set(**{name: check(value) if check and value is not None else value})
        return self

    def _set(self, **kwargs: Any):
        for name, value in kwargs.items():  # None is a value here
            self._paramMap[getattr(self, name)] = value
        return self

    def p(self, name: str) -> Any:
        """A parameter's value; a ValueError if it is required and not set."""
        if not self.isDefined(name):
            raise ValueError(f"{type(self).__name__}: {name} must be set")
        return self.getOrDefault(name)

    def inputs(self) -> list[str]:
        """Names of the columns that the stage reads."""
        if self.p("inputCols") is not None:
            return list(self.p("inputCols"))
        if self.p("inputCol") is None:
            raise ValueError(f"{type(self).__name__}: inputCol or inputCols must be set")
        return [self.p("inputCol")]

    def outputs(self) -> list[str]:
        """Names of the columns that the stage makes."""
        if self.p("outputCols") is not None:
            return list(self.p("outputCols"))
        if self.p("outputCol") is None:
            raise ValueError(f"{type(self).__name__}: outputCol or outputCols must be set")
        return [self.p("outputCol")]

    def operand(self, schema: T.StructType, name: str) -> tuple[Column, T.DataType]:
        """An input column, cast to inputDtype, and its type."""
        kind, col = column_type(schema, name), F.col(name)
        to = self.p("inputDtype")
        if to is not None:
            col, kind = cast_elements(col, kind, to), _with_element(kind, TYPES[to])
        require_type(f"{type(self).__name__} ({name})", kind, self.ACCEPTS)
        return col, kind

    def operands(self, schema: T.StructType) -> tuple[list[Column], list[T.DataType]]:
        """All input columns and their types."""
        found = [self.operand(schema, name) for name in self.inputs()]
        return [c for c, _ in found], [k for _, k in found]

    def spec(self) -> dict[str, Any]:
        """The stage as plain data: class, uid and set parameters."""
        return {"class": type(self).__name__, "uid": self.uid, "params": {p.name: v for p, v in self._paramMap.items()}}

    @staticmethod
    def from_spec(spec: dict[str, Any]) -> Stage:
        stage = REGISTRY[spec["class"]](**spec["params"])
        stage._resetUid(spec["uid"])
        return stage

    def copy(self, extra: dict | None = None):
        that = copy.copy(self)
        that._paramMap, that._defaultParamMap = dict(self._paramMap), dict(self._defaultParamMap)
        for param, value in (extra or {}).items():
            if self.hasParam(param.name):
                that.setParams(**{param.name: value})
        return that


def _with_element(kind: T.DataType, to: T.DataType) -> T.DataType:
    return T.ArrayType(_with_element(kind.elementType, to)) if isinstance(kind, T.ArrayType) else to


class Operator(Stage, Transformer):
    """A stage whose output columns are expressions of its input columns."""

    #: Whether an output depends on its own row alone.
    ROW_WISE = True

    def helpers(self, schema: T.StructType) -> dict[str, Column]:
        """Columns that must be there before the expressions are evaluated; they are dropped afterwards."""
        return {}

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column | list[Column]:
        raise NotImplementedError

    def expressions(self, schema: T.StructType) -> dict[str, Column]:
        """Output names and their expressions, before outputDtype."""
        made = self.build(*self.operands(schema))
        return dict(zip(self.outputs(), made if isinstance(made, list) else [made], strict=True))

    def before(self, df: DataFrame) -> DataFrame:
        """A chance to join something to the rows; must not change their number."""
        return df

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_together(dataset, [self])


def apply_together(df: DataFrame, stages: Iterable[Operator]) -> DataFrame:
    """Applies stages that don't read each other's outputs, in one projection."""
    stages, given = list(stages), set(df.columns)
    for stage in stages:
        df = stage.before(df)
    schema = df.schema
    helpers = {k: v for s in stages for k, v in s.helpers(schema).items()}
    if helpers:
        df = df.withColumns(helpers)
        schema = df.schema
    made: dict[str, Column] = {}
    for stage in stages:
        try:
            found = stage.expressions(schema)
            if (to := stage.p("outputDtype")) is not None:
                kinds = df.select(*[c.alias(n) for n, c in found.items()]).schema
                found = {n: cast_elements(c, kinds[n].dataType, to) for n, c in found.items()}
        except (ValueError, TypeError) as e:
            e.add_note(f"in stage {stage.uid}: {stage.spec()['params']}")
            raise
        made |= found
    df = df.withColumns(made)
    own = [n for n in df.columns if n.startswith("__lw_") and n not in given and n not in made]
    return df.drop(*own) if own else df


class Learner(Stage, Estimator):
    """A stage that learns parameters from rows and gives an operator that has them."""

    MODEL: ClassVar[type[Operator]]
    PARAMS: ClassVar[dict[str, Any]] = {}

    def _fit(self, dataset: DataFrame) -> Operator:
        from loomwright.plans.fitting import fit_together

        return fit_together(dataset, [self])[0]

    def model(self, **learned: Any) -> Operator:
        """The operator with the learned parameters and those of the same name here."""
        shared = {k: self.getOrDefault(k) for k in self.MODEL.ALL if k in self.ALL and self.isDefined(k)}
        return self.MODEL(**{**shared, **learned})


def operators(uses_udf: bool | None = None, row_wise: bool | None = None, kind: type | None = None) -> dict[str, type[Stage]]:
    """Registered stages by name: all, or those that (don't) run Python code or need other rows, or have a base class."""

    def has(stage: type[Stage], name: str, wanted: bool | None, default: bool) -> bool:
        return wanted is None or bool(getattr(stage, name, default)) == wanted

    return {n: c for n, c in sorted(REGISTRY.items()) if has(c, "USES_UDF", uses_udf, False) and has(c, "ROW_WISE", row_wise, False) and (kind is None or issubclass(c, kind))}
