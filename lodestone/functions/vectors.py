"""Vector functions on array columns, in double precision.

The folds run outside whole-stage codegen; for wide vectors over many rows use
``operators.dense``, which compares blocks with numpy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 1e-8) -> Column:
    # The norm is bound once: inside the inner function it would be taken again for every element.
    held = F.array(F.struct(v.alias("v"), (norm(v) + F.lit(eps)).alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), F.lit(0))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance: lower is nearer."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def truncated(v: Column, dim: int) -> Column:
    """The first dimensions, normalised again."""
    return normalised(F.slice(v, 1, dim))
