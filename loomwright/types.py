"""The eight element types, and what is asked of nested array types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Name in stage parameters to Spark type.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}
FLOATS = ("float", "double")
INTEGERS = ("tinyint", "smallint", "int", "bigint")
NUMBERS = FLOATS + INTEGERS
TEMPORAL = ("date", "timestamp", "timestamp_ntz")


def depth(kind: T.DataType) -> int:
    """How many arrays the type is nested in."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def element(kind: T.DataType) -> T.DataType:
    """The innermost element type."""
    return element(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def name_of(kind: T.DataType) -> str:
    """The short name of a type's element, such as bigint."""
    return element(kind).simpleString()


def column_type(schema: T.StructType, path: str) -> T.DataType:
    """The type of a column, or of a field by a dotted path into structs."""
    if path in schema.names:
        return schema[path].dataType
    kind: T.DataType = schema
    for part in path.replace("`", "").split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise ValueError(f"there is no column {path!r}; there are {schema.names}")
        kind = kind[part].dataType
    return kind


def require_type(owner: str, kind: T.DataType, accepted: tuple[str, ...] | None) -> None:
    if accepted is not None and name_of(kind) not in accepted:
        raise TypeError(f"{owner}: elements of type {name_of(kind)} are not accepted, only {', '.join(accepted)}")
