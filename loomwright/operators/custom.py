"""A function of the user's, over batches of rows."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.stage import REQUIRED, Operator
from loomwright.types import T


def load_function(path: str) -> Callable[..., Any]:
    """The function that ``module:name`` names."""
    module, _, name = path.partition(":")
    found: Any = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found


#: Key of a pickled function among saved parameters.
PICKLED = "pickled"


def _restored(given: Any) -> Any:
    """A function of its saved form; anything else as it is."""
    return cloudpickle.loads(base64.b64decode(given[PICKLED])) if isinstance(given, dict) and PICKLED in given else given


class LambdaFunctionTransformer(Operator):
    """A function of one pandas Series for each input; it returns one Series, or one for each output.

    ``function`` is the function, or ``module:name``. A function is saved pickled, with what it refers
    to, and unpickling runs code: load such pipelines only from where you trust. ``functionReturnTypes``
    are the outputs' Spark types, as DDL.
    """

    USES_UDF = True
    PARAMS = {"function": REQUIRED, "functionReturnTypes": REQUIRED}
    CHECKS = {"function": _restored}

    def spec(self) -> dict[str, Any]:
        found = super().spec()
        given = found["params"].get("function")
        if callable(given):
            found["params"]["function"] = {PICKLED: base64.b64encode(cloudpickle.dumps(given)).decode()}
        return found

    def build(self, cols: list[Column], kinds: list[T.DataType]) -> Column | list[Column]:
        import pandas as pd

        given, types, names = self.p("function"), list(self.p("functionReturnTypes")), self.outputs()
        if len(types) != len(names):
            raise ValueError("functionReturnTypes must have a type for each output")
        call = (lambda *x: load_function(given)(*x)) if isinstance(given, str) else given
        if len(names) == 1:

            def one(*x: pd.Series) -> pd.Series:
                return call(*x)

            one.__annotations__ = {"x": pd.Series, "return": pd.Series}
            return F.pandas_udf(one, types[0])(*cols)

        def several(*x: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({f"o{i}": s for i, s in enumerate(call(*x))})

        several.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
        made = F.pandas_udf(several, ", ".join(f"o{i} {t}" for i, t in enumerate(types)))(*cols)
        return [made[f"o{i}"] for i in range(len(names))]
