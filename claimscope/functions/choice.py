"""Categories by relative weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_choice(values: Sequence[str], weights: Sequence[float], u: Column) -> Column:
    """One of ``values`` with the given relative weights (cumulative thresholds
    over a uniform ``u``)."""
    total = float(sum(weights))
    expr, acc = None, 0.0
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        acc += w / total
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    last = F.lit(values[-1])
    return last if expr is None else expr.otherwise(last)
