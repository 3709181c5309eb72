"""User functions: scalar, aggregate and table functions in Python, called from the dialect by name."""

import inspect
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass
class UserFunction:
    name: str
    registered: str
    kind: str
    returns: list[str]
    nullable: bool = True
    parameters: tuple[str, ...] = ()


def _tolerant(fn: Callable, null_on_error: bool) -> Callable:
    def run(*args):
        try:
            return fn(*args)
        except Exception:
            if null_on_error:
                return None
            raise

    return run


def register(spark: SparkSession, registry: dict[str, UserFunction], name: str, fn: Callable, returns: str | list[str] = "double", kind: str = "scalar", null_on_error: bool = True) -> UserFunction:
    """Scalar: one row's values in, a value out. Aggregate: a list for each argument in, a value out. Several ``returns`` make a struct c0, c1, ...

    Scalars run on Arrow batches, aggregates on a group's pandas series.
    """
    kinds = [returns] if isinstance(returns, str) else list(returns)
    form = kinds[0] if len(kinds) == 1 else "struct<" + ", ".join(f"c{k}: {t}" for k, t in enumerate(kinds)) + ">"
    safe = _tolerant(fn, null_on_error)
    # A name of its own each time: queries compiled before keep the function that they were compiled with.
    registered = f"__udf_{name.lower()}_{uuid.uuid4().hex[:12]}"
    parameters = tuple(inspect.signature(fn).parameters)
    if kind == "scalar":
        spark.udf.register(registered, F.udf(safe, form, useArrow=True))
    elif kind == "aggregate":
        if len(kinds) > 1:
            raise ValueError("an aggregate with several results is several aggregates")

        def aggregate(*columns: pd.Series) -> float:
            return safe(*(c.tolist() for c in columns))

        spark.udf.register(registered, F.pandas_udf(aggregate, form))
    else:
        raise ValueError(f"unknown kind {kind}")
    made = UserFunction(name, registered, kind, kinds, null_on_error, parameters)
    registry[name.lower()] = made
    return made

