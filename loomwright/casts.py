"""Casts between the element types that give NULL where a value has no counterpart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.nested import map_leaf
from loomwright.types import FLOATS, TYPES, T, name_of


def cast_elements(col: Column, kind: T.DataType, to: str) -> Column:
    """Casts every element; -0.0 counts as 0.0, and what can't be cast becomes NULL."""
    if to not in TYPES:
        raise ValueError(f"{to!r} is no element type; there are {', '.join(TYPES)}")
    if name_of(kind) == to:
        return col

    def leaf(x: Column) -> Column:
        if name_of(kind) in FLOATS:
            x = F.when(x == 0, F.abs(x)).otherwise(x)
        return x.try_cast(TYPES[to])

    return map_leaf([col], [kind], leaf)
