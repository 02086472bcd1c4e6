"""Layered column expressions.

A calculation is a list of layers; a layer names new columns and gives each an expression over the columns below it.
Spark gets one projection a layer (Catalyst collapses what it can, and shared intermediates are computed once), and the
same list renders as nested SELECTs for any other SQL engine. Expressions keep to what SQL dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layer = dict[str, str]


def num(x: float) -> str:
    """A double literal in any dialect."""
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}e0)"


def f32(x: float | str) -> str:
    """A 32-bit literal or cast."""
    return f"CAST({num(x) if isinstance(x, (int, float)) else x} AS FLOAT)"


def whole(expr: str) -> str:
    """Floor as a 64-bit integer; dialects differ in how they cast fractions."""
    return f"CAST(floor({expr}) AS BIGINT)"


def div(a: str, b: str | int) -> str:
    """Integer quotient of non-negative integers below 2**53."""
    return whole(f"CAST({a} AS DOUBLE) / {b}")


def apply(df: DataFrame, layers: list[Layer]) -> DataFrame:
    """Add the columns of each layer; a name that exists is replaced. See :func:`fenced` before filtering or joining on them."""
    for layer in layers:
        kept = [f"`{c}`" for c in df.columns if c not in layer]
        df = df.selectExpr(*kept, *[f"{e} AS `{n}`" for n, e in layer.items()])
    return df


def fenced(df: DataFrame) -> DataFrame:
    """The same rows through a generator, through which no expression moves.

    The optimizer pushes a filter (or a join's null check) on a layered column below the layers by writing each name
    out, over and over, until the expression no longer fits in memory. Select what is needed, fence, then filter.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def render(layers: list[Layer], base: str, columns: list[str]) -> str:
    """The same as SQL text: nested SELECTs over ``base`` (a query or a table) with the final columns."""
    sql = base if base.lstrip().upper().startswith("SELECT") else f"SELECT * FROM {base}"
    for layer in layers:
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({sql}) AS q"
    return f"SELECT {', '.join(columns)} FROM ({sql}) AS q"
