"""Column-level functions: term counting, classification, text and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms, text  # noqa: F401


def add_columns_once(df: DataFrame, cols: dict[str, Column],
                     keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Append expensive columns, each evaluated once per row, and optionally
    keep only rows where ``keep(row_struct)`` holds.

    Catalyst pushes a filter on a derived column below the projection that
    defines it by inlining the expression, so ``withColumn(x, e).where(p(x))``
    evaluates ``e`` twice (in the filter and again in the projection) and
    nests any expensive input expression into both.  Generating the columns
    with ``inline`` of a one-element array (empty when ``keep`` fails) is a
    Generate node: predicates on its output cannot move below it, so every
    expression runs exactly once.  Measured on whole documents: 26 s -> 3 s.
    """
    s = F.struct(*[e.alias(n) for n, e in cols.items()])
    arr = F.array(s)
    if keep is not None:
        arr = F.filter(arr, keep)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(arr))
