"""Grids of stage parameters to try."""

from __future__ import annotations

from typing import Any

from pyspark.ml.tuning import ParamGridBuilder

from loomwright.plans.pipeline import FeaturePipeline


def choices(spec: dict[str, Any]) -> list[Any]:
    """The values of {"kind": "choice" | "boolean" | "fixed" | "int" | "float", ...}.

    choice: values; fixed: value; int: min, max and step; float: min, max and steps (a number of them).
    """
    match spec["kind"]:
        case "choice":
            return list(spec["values"])
        case "boolean":
            return [False, True]
        case "fixed":
            return [spec["value"]]
        case "int":
            return list(range(spec["min"], spec["max"] + 1, spec.get("step", 1)))
        case "float":
            n = spec.get("steps", 5)
            return [spec["min"] + (spec["max"] - spec["min"]) * i / max(n - 1, 1) for i in range(n)]
    raise ValueError(f"unknown kind of parameter: {spec['kind']!r}")


def grid(pipeline: FeaturePipeline, specs: dict[str, dict[str, dict[str, Any]]]) -> list[dict]:
    """All combinations of {layer name: {parameter: spec}} as parameter maps for ``pipeline.copy``."""
    builder, stages = ParamGridBuilder(), {s.p("layerName"): s for s in pipeline.expand()}
    for layer, params in specs.items():
        for name, spec in params.items():
            builder.addGrid(stages[layer].getParam(name), choices(spec))
    return builder.build()
