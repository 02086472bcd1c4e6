"""Reading the driver's tables and the pieces that queries and their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.layers import Layer, apply, render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    """Decorator form of :func:`register`."""

    def add(function: Query) -> Query:
        register(name, function, oracle)
        return function

    return add


def layered(name: str, source: str, base: Layer, layers: list[Layer], out: Layer) -> None:
    """A query whose work is layered expressions, and the same layers as its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in base.items()])
        return apply(df, layers).selectExpr(*[f"{e} AS {n}" for n, e in out.items()])

    inner = f"SELECT {', '.join(f'{e} AS {n}' for n, e in base.items())} FROM {source}"
    register(name, run, render(layers, inner, [f"{e} AS {n}" for n, e in out.items()]))


def sky(key: str) -> Layer:
    """A point of the sky from an integer key, the same on any engine."""
    return {"id": f"CAST({key} AS BIGINT)", "lon": f"CAST(({key} * 7919) % 360000 AS DOUBLE) / 1e3", "lat": f"CAST(({key} * 104729) % 180001 AS DOUBLE) / 1e3 - 90e0"}


def rounded(*names: str, digits: int = 7) -> Layer:
    return {n: f"round({n}, {digits})" for n in names}
