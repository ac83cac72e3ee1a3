"""Vectors as ARRAY<FLOAT>, products in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_CEILING = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by the norm, where that is over 0."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def first_stage_k(requested: int | str | None, gallery: int) -> int:
    """Neighbours that reach the second stage: all, up to the ceiling, or a number within the gallery."""
    if gallery <= 0:
        return 0
    if requested is None or requested == "all":
        return min(gallery, EXACT_CEILING)
    return max(1, min(int(requested), gallery))


def first_stage(requested: Column, gallery: Column) -> Column:
    """`first_stage_k` for each row; NULL requests all."""
    return F.when(gallery <= 0, 0).when(requested.isNull(), F.least(gallery, F.lit(EXACT_CEILING))).otherwise(F.greatest(F.lit(1), F.least(requested, gallery)))
