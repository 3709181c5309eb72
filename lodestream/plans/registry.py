"""Where the queries of the library and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import shared_folder
from ..session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    s.register_dir(sf_dir)
    return s


def stored(spark: SparkSession, sf_dir: str) -> Session:
    """A session with a store of its own in the shared folder."""
    import uuid

    s = Session(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    s.register_dir(sf_dir)
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect; its oracle is the same text where that is SQL too."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).query(text)
    ORACLES[name] = oracle or text


def query(oracle: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


#: Events with their time in epoch milliseconds, for oracles.
EV = "(SELECT *, (epoch_us(ts) // 1000) AS _time FROM events)"
