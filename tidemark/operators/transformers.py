"""Transformers: projections over feature columns, side by side or one after the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TidemarkError

Transformer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StandardScaler:
    """``(column - mean) / deviation`` for pairs of (input, output) names, one mean and deviation for all.

    A missing input gives a missing output.  Inputs keep their place; an output named like
    an input replaces it."""

    pairs: Sequence[tuple[str, str]]
    mean: float
    deviation: float

    def __post_init__(self) -> None:
        if self.deviation == 0:
            raise TidemarkError("the deviation must not be 0")

    def columns(self) -> list[Column]:
        return [((F.col(f"`{a}`") - F.lit(self.mean)) / F.lit(self.deviation)).alias(b) for a, b in self.pairs]

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {b for _, b in self.pairs}
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *self.columns())


@dataclass(frozen=True)
class ParallelTransformer:
    """All steps read the same input; their outputs stand next to each other in one projection."""

    steps: Sequence[StandardScaler]

    def __call__(self, df: DataFrame) -> DataFrame:
        names = [b for s in self.steps for _, b in s.pairs]
        if len(set(names)) != len(names):
            raise TidemarkError("outputs of parallel steps must have different names")
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(names)], *[c for s in self.steps for c in s.columns()])


@dataclass(frozen=True)
class Pipeline:
    """Transformers one after the other; none leaves the input as it is."""

    steps: Sequence[Transformer] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s)
        return df


def to_ml(df: DataFrame, columns: Sequence[str], dtype: str = "float") -> DataFrame:
    """Missing cells as NaN and a narrower type, for the edge to numerical libraries."""
    cast = {c: F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))).cast(dtype) for c in columns}
    return df.select(*[cast[c].alias(c) if c in cast else F.col(f"`{c}`") for c in df.columns])
