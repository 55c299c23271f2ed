"""Fitting several estimators together: one aggregation for all that count numbers, one for all vocabularies."""

from __future__ import annotations

import functools
from collections import defaultdict
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.stage import Learner, Operator
from loomwright.types import column_type, depth


def _sampled(df: DataFrame, fraction: float | None, seed: int | None) -> DataFrame:
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


def fit_together(df: DataFrame, learners: list[Learner]) -> list[Operator]:
    """The operators that the learners learn from the rows, in the same order.

    Numeric learners with the same sample share one aggregation over the rows, those of arrays
    nested deeper than once excepted; vocabularies share one count of labels.
    """
    learned: dict[int, dict[str, Any]] = {}
    shared: dict[tuple, list[int]] = defaultdict(list)
    words: list[int] = []
    for i, learner in enumerate(learners):
        if hasattr(learner, "labels"):
            words.append(i)
            continue
        nested = any(depth(column_type(df.schema, n)) > 1 for n in learner.inputs())
        shared[learner.p("sampleFraction"), learner.p("sampleSeed"), i if nested else None].append(i)
    widths = _widths(df, [learners[i] for group in shared.values() for i in group])
    for (fraction, seed, _), group in shared.items():
        rows = _sampled(df, fraction, seed)
        wanted = {}
        for i in group:
            rows, parts = learners[i].aggregates(rows, widths[learners[i].uid])
            wanted |= {f"{i}_{k}": c for k, c in parts.items()}
        found = rows.agg(*[c.alias(k) for k, c in wanted.items()]).first().asDict()
        for i in group:
            learned[i] = {k.removeprefix(f"{i}_"): v for k, v in found.items() if k.startswith(f"{i}_")}
            if hasattr(learners[i], "refine"):
                learned[i] = learners[i].refine(rows, learned[i])
    out: dict[int, Operator] = {i: learners[i].learn(values, widths[learners[i].uid]) for i, values in learned.items()}
    if words:
        out |= _vocabularies(df, {i: learners[i] for i in words})
    return [out[i] for i in range(len(learners))]


def _widths(df: DataFrame, learners: list[Learner]) -> dict[str, int]:
    """Lengths of the innermost arrays that each learner reads, from one row that has all of them; 1 for scalars."""
    sizes, scalar = {}, {}
    for learner in learners:
        cols, kinds = learner.operands(df.schema)
        col, levels = cols[0], depth(kinds[0])
        if not levels:
            scalar[learner.uid] = 1
            continue
        for _ in range(levels - 1):
            col = F.get(col, F.lit(0))
        sizes[learner.uid] = F.size(col)
    if not sizes:
        return scalar
    names = [f"w{i}" for i in range(len(sizes))]
    wide = df.select(*[c.alias(n) for c, n in zip(sizes.values(), names, strict=True)])
    row = wide.where(functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).first()
    if row is None:
        raise ValueError("there is no row with all arrays to be scaled")
    return scalar | dict(zip(sizes, row, strict=True))


def _vocabularies(df: DataFrame, learners: dict[int, Learner]) -> dict[int, Operator]:
    given = [(i, *one) for i, learner in learners.items() for one in learner.labels(df.schema)]
    single = [F.struct(F.lit(i).alias("i"), label.alias("label")) for i, label, many in given if not many]
    arrays = [_tagged(labels, i) for i, labels, many in given if many]
    if len(given) == len(single) == 1:
        found = df.select(F.lit(given[0][0]).alias("i"), given[0][1].alias("label"))
    else:
        found = df.select(F.explode(F.concat(*([F.array(*single)] if single else []), *arrays)).alias("x")).select("x.i", "x.label")
    found = found.where("label is not null")
    counts = found.groupBy("i", "label").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {i: learner.learn(counts.where(F.col("i") == i)) for i, learner in learners.items()}
    finally:
        counts.unpersist()


def _tagged(labels, i: int):
    """The labels of one learner as structs; a NULL array counts as empty."""
    made = F.transform(labels, lambda x: F.struct(F.lit(i).alias("i"), x.alias("label")))
    return F.coalesce(made, F.array().cast("array<struct<i:int,label:string>>"))
