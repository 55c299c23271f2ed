"""Lifting functions of columns over nested arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.types import T, depth


def map_leaf(cols: Sequence[Column], kinds: Sequence[T.DataType], fn: Callable[..., Column]) -> Column:
    """``fn`` of the elements of all columns, place by place.

    Columns that are no arrays count for every place; the others must be nested equally deep.
    """
    depths = {d for d in map(depth, kinds) if d}
    if not depths:
        return fn(*cols)
    if len(depths) > 1:
        raise ValueError(f"arrays of unequal nesting: {[k.simpleString() for k in kinds]}")
    return _lift(list(cols), [depth(k) for k in kinds], fn)


def _lift(cols: list[Column], depths: list[int], fn: Callable[..., Column]) -> Column:
    arrays = [i for i, d in enumerate(depths) if d]
    if not arrays:
        return fn(*cols)
    inner = [max(d - 1, 0) for d in depths]

    def at(values: dict[int, Column]) -> Column:
        return _lift([values.get(i, c) for i, c in enumerate(cols)], inner, fn)

    if len(arrays) == 1:
        return F.transform(cols[arrays[0]], lambda x: at({arrays[0]: x}))
    if len(arrays) == 2:
        return F.zip_with(cols[arrays[0]], cols[arrays[1]], lambda x, y: at({arrays[0]: x, arrays[1]: y}))
    zipped = F.transform(cols[arrays[0]], lambda x: F.struct(x.alias("v0")))
    for n, i in enumerate(arrays[1:], 1):
        zipped = _grown(zipped, cols[i], n)
    return F.transform(zipped, lambda s: at({i: s[f"v{n}"] for n, i in enumerate(arrays)}))


def _grown(zipped: Column, more: Column, n: int) -> Column:
    return F.zip_with(zipped, more, lambda s, x: F.struct(*[s[f"v{k}"].alias(f"v{k}") for k in range(n)], x.alias(f"v{n}")))


def map_inner(cols: Sequence[Column], kinds: Sequence[T.DataType], fn: Callable[..., Column]) -> Column:
    """``fn`` of the innermost arrays of all columns, place by place; all must be nested equally deep."""
    depths = {depth(k) for k in kinds}
    if len(depths) > 1 or 0 in depths:
        raise TypeError(f"arrays of equal nesting are needed, not {[k.simpleString() for k in kinds]}")
    outer = depths.pop() - 1
    return _lift(list(cols), [outer] * len(cols), fn)
