"""Pipelines: stages as a graph over column names, applied level by level.

A level holds stages that don't read each other's outputs; it becomes one projection. Fitting needs
only the stages that an estimator reads from, directly or not; the estimators of a level are fitted
together.
"""

from __future__ import annotations

import graphlib
import json
import uuid
from typing import Any

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame, SparkSession

import loomwright.operators  # noqa: F401  (registers the stages)
from loomwright.plans.fitting import fit_together
from loomwright.stage import Learner, Operator, Stage, apply_together


def _query_columns(stage: Stage) -> list[str]:
    """All columns that a stage reads, those beside its inputs as well."""
    names = list(stage.inputs())
    for param in ("queryIdCol", "relevanceCol"):
        if param in stage.ALL and stage.p(param) is not None:
            names.append(stage.p(param))
    for param in ("maskCols", "tieBreakCols"):
        if param in stage.ALL and stage.p(param) is not None:
            names += stage.p(param)
    return [n for name in names for n in {name, name.split(".")[0]}]


class Graph:
    """The stages by what they read and make.

    A stage depends on the stage before it in the list that last made a column that it reads or
    makes, and on those that read a column that it makes anew. A column that only a later stage
    makes, and no input has, is waited for.
    """

    def __init__(self, stages: list[Stage], columns: list[str] | None = None) -> None:
        self.stages = stages
        makers: dict[str, list[int]] = {}
        for i, stage in enumerate(stages):
            for name in stage.outputs():
                makers.setdefault(name, []).append(i)
        self.needs: dict[int, set[int]] = {i: set() for i in range(len(stages))}
        readers: dict[str, set[int]] = {}
        for i, stage in enumerate(stages):
            for name in _query_columns(stage):
                made = makers.get(name, [])
                before = [m for m in made if m < i]
                if before:
                    self.needs[i].add(before[-1])
                elif made and made[0] != i and (columns is None or name not in columns):
                    self.needs[i].add(made[0])
                readers.setdefault(name, set()).add(i)
            for name in stage.outputs():
                before = [m for m in makers[name] if m < i]
                if before:
                    self.needs[i].add(before[-1])
                    self.needs[i] |= {r for r in readers.get(name, ()) if before[-1] < r < i}
                elif columns is not None and name in columns:
                    self.needs[i] |= {r for r in readers.get(name, ()) if r < i}

    def levels(self) -> list[list[int]]:
        sorter, out = graphlib.TopologicalSorter(self.needs), []
        try:
            sorter.prepare()
        except graphlib.CycleError as e:
            raise ValueError(f"the stages depend on each other in a circle: {e.args[1]}") from e
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out.append(ready)
            sorter.done(*ready)
        return out

    def ancestors(self, of: list[int]) -> set[int]:
        found: set[int] = set()
        todo = list(of)
        while todo:
            for n in self.needs[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return found

    def edges(self) -> list[tuple[str, str]]:
        """(stage, stage) pairs, by layer name, of which the second needs the first."""
        return sorted((self.stages[a].p("layerName"), self.stages[b].p("layerName")) for b, many in self.needs.items() for a in many)


def _flat(stages: list[Any]) -> list[Stage]:
    out: list[Stage] = []
    for stage in stages:
        if isinstance(stage, (FeaturePipeline, FeaturePipelineModel)):
            out += _flat(stage.stages)
        elif isinstance(stage, Stage):
            out.append(stage)
        else:
            raise TypeError(f"{stage!r} is no stage")
    return out


def _write(spark: SparkSession, path: str, spec: dict[str, Any], overwrite: bool) -> None:
    try:
        text = json.dumps(spec, indent=1)
    except TypeError as e:
        raise ValueError("only stages with plain parameters can be saved; name functions as module:name") from e
    rows = spark.createDataFrame([(text,)], "value string").coalesce(1)
    rows.write.mode("overwrite" if overwrite else "error").text(path)


def _read(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


class _Saved:
    stages: list[Any]
    uid: str

    def spec(self) -> dict[str, Any]:
        return {"class": type(self).__name__, "uid": self.uid, "stages": [s.spec() for s in _flat(self.stages)]}

    def save(self, path: str, overwrite: bool = False) -> None:
        """Writes the stages as JSON, wherever Spark writes."""
        _write(SparkSession.active(), path, self.spec(), overwrite)

    @classmethod
    def load(cls, path: str):
        spec = _read(SparkSession.active(), path)
        if spec["class"] != cls.__name__:
            raise ValueError(f"{path} holds a {spec['class']}")
        return cls([Stage.from_spec(s) for s in spec["stages"]], spec["uid"])


class FeaturePipelineModel(_Saved, Transformer):
    """Operators, applied level by level."""

    def __init__(self, stages: list[Any], uid: str | None = None) -> None:
        super().__init__()
        self.stages = _flat(stages)
        if uid:
            self._resetUid(uid)
        for stage in self.stages:
            if not isinstance(stage, Operator):
                raise TypeError(f"{stage.uid} is not fitted")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for level in Graph(self.stages, dataset.columns).levels():
            dataset = apply_together(dataset, [self.stages[i] for i in level])
        return dataset

    def copy(self, extra=None):
        return FeaturePipelineModel([s.copy(extra) for s in self.stages], self.uid)

    def lineage(self) -> dict[str, dict[str, Any]]:
        """For each column that is made, the stage, its class and what it reads."""
        return {n: {"stage": s.p("layerName"), "class": type(s).__name__, "reads": _query_columns(s)} for s in self.stages for n in s.outputs()}


class FeaturePipeline(_Saved, Estimator):
    """Operators and estimators; pipelines among them are taken apart."""

    def __init__(self, stages: list[Any] | None = None, uid: str | None = None) -> None:
        super().__init__()
        self.stages = list(stages or [])
        self._resetUid(uid or f"FeaturePipeline_{uuid.uuid4().hex[:12]}")

    def setStages(self, stages: list[Any]) -> FeaturePipeline:  # noqa: N802
        self.stages = list(stages)
        return self

    def getStages(self) -> list[Any]:  # noqa: N802
        return self.stages

    def expand(self) -> list[Stage]:
        return _flat(self.stages)

    def graph(self, columns: list[str] | None = None) -> Graph:
        return Graph(self.expand(), columns)

    def _fit(self, dataset: DataFrame) -> FeaturePipelineModel:
        stages = self.expand()
        graph = Graph(stages, dataset.columns)
        needed = graph.ancestors([i for i, s in enumerate(stages) if isinstance(s, Learner)])
        fitted: list[Operator | None] = [s if isinstance(s, Operator) else None for s in stages]
        for level in graph.levels():
            learners = [i for i in level if isinstance(stages[i], Learner)]
            if learners:
                for i, model in zip(learners, fit_together(dataset, [stages[i] for i in learners]), strict=True):
                    fitted[i] = model
            if now := [fitted[i] for i in level if i in needed]:
                dataset = apply_together(dataset, now)
        return FeaturePipelineModel(fitted)

    def copy(self, extra=None):
        return FeaturePipeline([s.copy(extra) for s in self.expand()], self.uid)
